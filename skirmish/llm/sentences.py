"""Sentence boundaries across languages and scripts.

The possible boundaries of a paragraph are the nodes of a lattice, its possible sentences the edges.
A gap behind a terminator brings evidence for or against a boundary (abbreviation, initial, number,
case of the next word); in scripts without spaces or terminators the evidence comes from the
words around the gap, cut by the best path through a dictionary lattice, by their final particles and
opening words. An edge costs what makes a bad sentence: one end of a quotation or bracket
whose other end it lacks, a quotation without the speaker that follows it. The best path is found
in one pass; a choice is revised if what comes later makes another path better.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skirmish.llm.mime import BLOCK_END, QUOTE_CLOSE, QUOTE_OPEN, html_text, text_parts

# ---- fixed values -----------------------------------------------------------------------------

# Abbreviations that never end a sentence: something follows them.
OPEN_ABBREVIATIONS = frozenset(
    """
    dr mr mrs ms prof st rev gen col capt lt sgt hon adm cmdr cdr maj cpl pvt brig supt insp gov sen rep pres amb atty msgr mt ft dept univ no nos vol fig figs sec secs ch chap pp cf vs e.g i.e viz apt ext exp ave al approx acct ref tel
    fa nr bzw z.b d.h u.a z.t str hr fr hrsg vgl ca evtl ggf inkl s.o tsd
    m mm mme mlle mlles mmes p p.ex chap art env av éd
    sr sra srta sres dra dres pág págs aprox núm cap ee art tfno avda d.ª
    см стр рис гл т.е т.к т.н напр др проф г ул им тыс млн млрд руб
    डॉ श्री प्रो पं सं
    د أ م
    """.split()
)
# Abbreviations that may end a sentence: the next word decides.
CLOSING_ABBREVIATIONS = frozenset("etc a.m p.m am pm usw u.s.w jr inc ltd co corp u.s e.u u.k ee.uu uu p.m mon tue wed thu fri sat sun jan feb mar apr jun jul aug sep sept oct nov dec и.т.д и.т.п т.д т.п".split())
GERMAN_MONTHS = frozenset("Januar Jänner Februar März April Mai Juni Juli August September Oktober November Dezember Jan Feb Apr Jun Jul Aug Sep Okt Nov Dez".split())

# Thai and Lao: polite and other final particles, words that open a sentence after a final, sentence
# connectives, words after which (OPEN_ENDS) or before which (LINKS) a clause goes on, words that begin a clause on which
# another depends, and common verbs and auxiliaries. Together they are the dictionary of the lattice.
THAI_POLITE = frozenset("ครับ ครับผม ค่ะ คะ นะครับ นะคะ จ้ะ จ้า จ๊ะ ฮะ ເດີ ເດີ້ ແດ່ ເນາະ".split())
THAI_FINALS = THAI_POLITE | frozenset("แล้ว นะ เลย ด้วย สิ ล่ะ มั้ย ไหม หรือยัง หรือเปล่า หรอก เถอะ ซะ ເທື່ອ ແລ້ວ ບໍ ນໍ".split())
THAI_OPENERS = frozenset(
    """
    คุณ เรียน สวัสดี ขอบคุณ ใคร ถ้า แต่ เพราะ กรุณา โปรด ช่วย ทำไม เมื่อ อย่างไร อะไร ที่ไหน เท่าไร
    ผม ดิฉัน ฉัน เรา พวกเรา เขา พวกเขา เธอ มัน ท่าน หนู นี่ นั่น วันนี้ พรุ่งนี้ เมื่อวาน เมื่อวานนี้ เมื่อคืน ตอนนี้ ขณะนี้ ปัจจุบัน ปีนี้ ปีที่แล้ว
    ຂ້ອຍ ເຈົ້າ ພວກເຮົາ ລາວ ເຂົາເຈົ້າ ມື້ນີ້ ມື້ອື່ນ ຂອບໃຈ ສະບາຍດີ ແຕ່
    """.split()
)
THAI_CONNECTIVES = frozenset("ดังนั้น เพราะฉะนั้น อย่างไรก็ตาม นอกจากนี้ นอกจากนั้น ทั้งนี้ จากนั้น หลังจากนั้น ต่อมา ในขณะเดียวกัน กล่าวคือ ດັ່ງນັ້ນ ນອກຈາກນັ້ນ".split())
THAI_OPEN_ENDS = frozenset("และ แต่ หรือ เพราะ ถ้า ว่า ของ กับ ให้ จาก ที่ ใน คือ จะ เมื่อ โดย เพื่อ ซึ่ง แก่ ต่อ ถึง ระหว่าง คุณ นาย นาง นางสาว เรียน เช่น ได้แก่ ທີ່ ແລະ ຂອງ ກັບ ໃນ ຈະ".split())
THAI_LINKS = frozenset("และ หรือ ว่า ที่ ซึ่ง อัน โดย เพื่อ จน จนกระทั่ง ก็ จึง กับ ของ จาก ใน เพราะ เนื่องจาก แก่ ด้วย เป็นต้น ฯลฯ แล้วก็ ທີ່ ແລະ ຫຼື ວ່າ".split())
THAI_DEPENDENT = frozenset("ถ้า หาก เมื่อ แม้ แม้ว่า ถึงแม้ ขณะที่ ก่อนที่ หลังจาก เนื่องจาก เพราะ ຖ້າ ເມື່ອ".split())
THAI_VERBS = frozenset(
    """
    ไป มา กิน ดื่ม นอน ชอบ รัก เกลียด อยาก ต้อง ควร จะ ได้ เป็น อยู่ มี คือ ทำ เห็น ดู ฟัง พูด บอก ถาม ตอบ คิด รู้ รู้จัก เข้าใจ จำ ลืม อ่าน เขียน ซื้อ ขาย ใช้ ให้ รับ ส่ง เอา
    นั่ง ยืน เดิน วิ่ง ขับ เล่น ทำงาน เรียนรู้ สอน เริ่ม หยุด เปิด ปิด เข้า ออก ขึ้น ลง กลับ ถึง อาศัย เกิด ตาย ช่วย รอ หา พบ เจอ ย้าย หาย เปลี่ยน เพิ่ม ลด ขาย สร้าง แก้ ตก สวย ดี ใหญ่ เล็ก ร้อน หนาว เย็น แพง ถูก ไม่ กำลัง เคย ยัง
    ໄປ ມາ ກິນ ນອນ ມັກ ຢາກ ຕ້ອງ ເປັນ ຢູ່ ມີ ເຮັດ ເຫັນ ເວົ້າ ຮູ້ ອ່ານ ຂຽນ ຊື້ ຂາຍ ບໍ່
    """.split()
)
THAI_WORDS = frozenset("กัน เวลา ทุก คน มาก นี้ นั้น วัน ขอ ความ นับถือ ตัว ปี เดือน การ ผู้ สิ่ง เรื่อง ครั้ง แห่ง อัน ชิ้น".split())
# Words by which a Japanese or Chinese sentence goes on after a quotation it carries.
JAPANESE_AFTER_QUOTE = frozenset("と って とは とか との という といい といって という は が を に の も で など".split())
CHINESE_SPEECH = frozenset("问道 问 说道 说 道 喊道 喊 答道 答 回答 回答道 叫道 叫 写道 写 想 问我 告诉 表示".split())
CJK_WORDS = frozenset("他 她 我 你 我们 他们 大家 小声 大声 又 就 才 也 的 了 是 这 那 聞いた 言った 尋ねた 答えた 書いた".split()) | CHINESE_SPEECH | JAPANESE_AFTER_QUOTE

OPENERS = "“«「『（(\\[{‘„‚〈《【"
CLOSERS = "”»」』）)\\]}’“‘\"'›〉》】"
_PAIRS = {"“": "”", "«": "»", "「": "」", "『": "』", "„": "“”", "（": "）", "(": ")", "《": "》"}

_BRACKET = re.compile("[" + re.escape("".join({*_PAIRS, *"".join(_PAIRS.values())})) + "]")
_FACE = re.compile(r"[:;=]['’]?[-o^]?[()](?!\w)")


def partners(text: str) -> dict[int, int]:
    """Closing place -> opening place of the quotations and brackets of a paragraph that have both.

    Faces such as ``:-(`` are no brackets; what opens within a pair and does not close
    there has no partner, nor has what never closes.
    """
    faces = {m.end() - 1 for m in _FACE.finditer(text)}
    out: dict[int, int] = {}
    waiting: list[tuple[int, str]] = []
    n_waiting = dict.fromkeys("".join(_PAIRS.values()), 0)
    for m in _BRACKET.finditer(text):
        i, ch = m.start(), m[0]
        if i in faces:
            continue
        before = text[i - 1 : i]
        inner = bool(before) and not before.isspace()  # what stands after a space does not close in a script with an opening twin
        if n_waiting.get(ch) and (ch not in _PAIRS or inner):
            while True:
                opened, closers = waiting.pop()
                for c in closers:
                    n_waiting[c] -= 1
                if ch in closers:
                    break
            out[i] = opened
        elif ch in _PAIRS and not (ch == "«" and (before.isalnum() or before and before in ".!?…,")):  # »so« in German
            waiting.append((i, _PAIRS[ch]))
            for c in _PAIRS[ch]:
                n_waiting[c] += 1
    return out


# ---- lattices ---------------------------------------------------------------------------------


def lattice_path(text: str, words: frozenset[str], longest: int = 10) -> list[str]:
    """Words of the cheapest path through the dictionary lattice of ``text``.

    A dictionary word costs one; a character outside the dictionary two. Unknown
    neighbours are joined. Ties prefer longer words.
    """
    n = len(text)
    cost = [0] * (n + 1)
    step = [1] * (n + 1)
    for i in range(n - 1, -1, -1):
        cost[i], step[i] = cost[i + 1] + 2, -1
        for k in range(1, min(longest, n - i) + 1):
            if text[i : i + k] in words and cost[i + k] + 1 <= cost[i]:
                cost[i], step[i] = cost[i + k] + 1, k
    out: list[str] = []
    i, unknown = 0, ""
    while i < n:
        if step[i] < 0:
            unknown += text[i]
            i += 1
            continue
        if unknown:
            out.append(unknown)
            unknown = ""
        out.append(text[i : i + step[i]])
        i += step[i]
    if unknown:
        out.append(unknown)
    return out


_THAI = re.compile("[\u0e00-\u0eff]")  # and Lao
_THAI_LEXICON = THAI_FINALS | THAI_WORDS | THAI_OPENERS | THAI_CONNECTIVES | THAI_OPEN_ENDS | THAI_LINKS | THAI_DEPENDENT | THAI_VERBS
_THAI_LONGEST = max(map(len, _THAI_LEXICON))
_CJK_LONGEST = max(map(len, CJK_WORDS))
_CONNECTIVES = tuple(THAI_CONNECTIVES)


def _is_clause(words: list[str]) -> bool:
    """Words that tell something: a verb and what it is about, not the beginning of a dependent clause."""
    return len(words) > 1 and words[0] not in THAI_DEPENDENT and any(w in THAI_VERBS for w in words[1:])


def _thai_gap(before: str, after: str) -> bool:
    """Is the space between two runs of Thai or Lao text a boundary? Both are given up to their next space."""
    if not before or not after or not _THAI.match(before[-1]):
        return False
    left = lattice_path(before, _THAI_LEXICON, _THAI_LONGEST)
    if left[-1] in THAI_POLITE:
        return True
    if left[-1] in THAI_OPEN_ENDS and left[-1] not in THAI_FINALS:
        return False
    right = lattice_path(after, _THAI_LEXICON, _THAI_LONGEST)
    if right[0] in THAI_CONNECTIVES or left[-1] in THAI_FINALS and right[0] in THAI_OPENERS:
        return True
    return bool(_THAI.match(after)) and right[0] not in THAI_LINKS and _is_clause(left) and _is_clause(right)


_CLAUSE_END = re.compile("[。！？，、；：“「.!?]")


def _carries_on(text: str, at: int) -> bool:
    """Does the sentence go on at ``at``, behind a quotation that closed with a terminator (no space between)?"""
    end = _CLAUSE_END.search(text, at)
    words = lattice_path(text[at : end.start() if end else len(text)], CJK_WORDS, _CJK_LONGEST)
    if not words:
        return text[at : at + 1] in "，、；：,"
    return words[0] in JAPANESE_AFTER_QUOTE or any(w in CHINESE_SPEECH for w in words)


# ---- evidence of gaps ---------------------------------------------------------------------------

# Terminators that need no capital behind them: danda, Urdu, Khmer, Burmese, Tibetan, Armenian, Ethiopic.
SCRIPT_STOPS = "।॥۔។៕။།༎։።"
_CANDIDATE = re.compile(rf"([.!?…。！？؟{SCRIPT_STOPS}]+)([{CLOSERS}]*(?:\s»)?)(\s*)")
_DELIMITER = re.compile(r"[\s(\[{“”«»„\"'‘’「『/]")
_INNER = re.compile(r"[./@]")
_OPENING = re.compile(rf"[{OPENERS}\"'¿¡\s–—-]*")
_INITIAL = re.compile(r"(?:[^\W\d_]\.)*[^\W\d_]$")
_NEXT_WORD = re.compile(r"\w+")
_LETTER = re.compile(r"[^\W\d_]")
# No abbreviation is longer; a longer word is none.
_LONGEST_ABBREVIATION = 24
# What a boundary brings, and what it costs to part the ends of a quotation or a quotation and its speaker.
EVIDENCE, PARTED, SPEECHLESS, FRAGMENT = 2.0, 9.0, 9.0, 4.0


def _abbreviation(word: str) -> str:
    """'open', 'closing', 'initial' or '' for the word before a full stop."""
    w = word.lower().strip(",;:-–—")
    if w in CLOSING_ABBREVIATIONS:
        return "closing"
    if w in OPEN_ABBREVIATIONS:
        return "open"
    if _INITIAL.fullmatch(word):
        return "initial"
    return ""


class _Words:
    """The word before a place, for places in rising order; reads the text once."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.borders, self.inner = _DELIMITER.finditer(text), _INNER.finditer(text)
        self.next_border, self.next_inner = next(self.borders, None), next(self.inner, None)
        self.start, self.last_inner = 0, -1

    def before(self, at: int) -> tuple[str, bool]:
        """The word that ends at ``at``, '' if too long for an abbreviation, and whether it is a plain word: letters in lower case at its end, no dot, slash or at."""
        while self.next_border and self.next_border.start() < at:
            self.start = self.next_border.end()
            self.next_border = next(self.borders, None)
        while self.next_inner and self.next_inner.start() < at:
            self.last_inner = self.next_inner.start()
            self.next_inner = next(self.inner, None)
        size = at - self.start
        plain = size > 1 and self.last_inner < self.start and self.text[at - 2 : at].isalpha() and self.text[at - 1].islower()
        return (self.text[self.start : at] if size <= _LONGEST_ABBREVIATION else ""), plain


def _ends_here(text: str, m: re.Match, words: _Words, closers: str, end: int, space: str, led_in: bool) -> bool:
    """Whether the neighbours of a gap speak for a boundary. ``led_in``: the quotation closed here was announced by a colon or comma."""
    mark = m[1]
    if end >= len(text):
        return True
    ahead = text[end]
    if mark[-1] in "。！？":
        if closers.strip():
            return led_in and ahead not in "，、；：," or not led_in and not _carries_on(text, end)
        return True
    if mark[0] == "…" and not space and not closers:
        return False
    opening = _OPENING.match(text, end).end()
    nxt = text[opening : opening + 1]
    if not space and not closers:
        # a missing space: only a word, a terminator and a capital (or a letter without case) are a boundary
        if mark[-1] in SCRIPT_STOPS or mark[-1] == "؟":
            return True
        if mark == ".":
            word, plain = words.before(m.start())
            return plain and nxt.isupper() and opening == end and not _abbreviation(word)
        return bool(nxt and (nxt.isupper() or opening > end))
    if not space:
        return bool(closers.strip("'\"’") and not nxt.islower() and ahead not in ",;:.!?…，、")
    if not nxt:
        return True
    if nxt.islower() and not _CAMEL.match(text, opening):
        return False
    if mark[-1] in SCRIPT_STOPS:
        return True
    if ahead in "–—-" and text[end + 1 : end + 2] == " ":
        return False
    cased = nxt.isupper() or nxt.isdigit() or nxt.islower()
    if mark == "." and not closers:
        word, _ = words.before(m.start())
        kind = _abbreviation(word)
        if kind in ("open", "initial"):
            return False
        if kind == "closing":
            return cased
        if word.isdigit() and len(word) <= 2:
            follow = _NEXT_WORD.match(text, opening)
            if follow and follow[0] in GERMAN_MONTHS:
                return False
    # in a caseless script a quotation inside the sentence carries on
    return cased or not closers.strip()


_QUOTES = "\"'“«„‘「"
_CAMEL = re.compile(r"[^\W\d_]+[A-Z]")
_SAYS = re.compile(r"[^\W\d_]+(?: [^\W\d_]+)? (?:said|asked|says|asks|wrote|replied|answered|shouted|fragte|sagte|rief|demanda|dit|dijo|preguntó|спросил|сказал|ने|ask|noted)(?!\w)")


class _Gap:
    """A node of the lattice: where a sentence may end, the evidence, whether a speaker follows the quotation closed there."""

    __slots__ = ("end", "cut", "evidence", "speaker")

    def __init__(self, end: int, cut: int, evidence: float, speaker: bool = False) -> None:
        self.end, self.cut, self.evidence, self.speaker = end, cut, evidence, speaker


def _gaps(text: str, opened: dict[int, int]) -> list[_Gap]:
    """The gaps with evidence for a boundary, in order."""
    out: list[_Gap] = []
    words = _Words(text)
    since = 0
    for m in _CANDIDATE.finditer(text):
        end, led_in = m.end(1), False
        for ch in m[2]:
            if end in opened:
                at = opened[end] - 1
                while at >= 0 and text[at] == " ":
                    at -= 1
                led_in = at >= 0 and text[at] in ":：，,"
            elif ch in "“‘":
                break  # opens the next quotation
            end += 1
        closers = text[m.end(1) : end]
        space = m[3] if end == m.end(2) else ""
        cut = end + len(space)
        if not _ends_here(text, m, words, closers, cut, space, led_in):
            continue
        opening = _OPENING.match(text, cut).end()
        speaker = bool(space and closers.strip(" )）") and _SAYS.match(text, opening))
        # a number of a list is no sentence
        lettered = _LETTER.search(text, since, m.start()) or m[1] != "."
        out.append(_Gap(end, cut, EVIDENCE if lettered else EVIDENCE - FRAGMENT, speaker))
        since = cut
        words.start = max(words.start, cut)  # a word begins behind a boundary without a space
    if _THAI.search(text):
        known = {g.cut for g in out}
        for g in re.finditer(" ", text):
            ends = text.find(" ", g.end())
            if g.end() not in known and _thai_gap(text[text.rfind(" ", 0, g.start()) + 1 : g.start()], text[g.end() : ends if ends >= 0 else len(text)]):
                out.append(_Gap(g.start(), g.end(), EVIDENCE))
        out.sort(key=lambda g: g.cut)
    return out


class _Starts:
    """The cheapest sentence start so far, each quotation or bracket opened since costing PARTED until it closes.

    A level for each open pair: the starts inside it, and the best of all starts as seen from it.
    """

    def __init__(self) -> None:
        self.own: list[tuple[float, int]] = [(float("inf"), -1)]
        self.best: list[tuple[float, int]] = [(float("inf"), -1)]

    def add(self, cost: float, node: int) -> None:
        self.own[-1] = min(self.own[-1], (cost, node))
        self.best[-1] = min(self.best[-1], (cost, node))

    def open(self) -> None:
        cost, node = self.best[-1]
        self.own.append((float("inf"), -1))
        self.best.append((cost + PARTED, node))

    def close(self) -> None:
        inside = self.own.pop()
        self.best.pop()
        self.own[-1] = min(self.own[-1], inside)
        cost, node = self.best[-2] if len(self.best) > 1 else (float("inf"), -1)
        self.best[-1] = min(self.own[-1], (cost + PARTED, node))


def split_paragraph(text: str) -> list[str]:
    """Sentences of one paragraph whose white space is already single spaces: the best path through its lattice."""
    if not text:
        return []
    opened = partners(text)
    gaps = _gaps(text, opened)
    gaps.append(_Gap(len(text), len(text), 0.0))
    borders = sorted([(o, 1) for o in opened.values()] + [(c, 0) for c in opened])
    starts = {False: _Starts(), True: _Starts()}
    starts[text[0] in _QUOTES].add(0.0, -1)
    before: list[int] = []
    at = 0
    for j, gap in enumerate(gaps):
        while at < len(borders) and borders[at][0] < gap.end:
            for s in starts.values():
                s.open() if borders[at][1] else s.close()
            at += 1
        plain, quoted = starts[False].best[-1], starts[True].best[-1]
        if gap.speaker:
            quoted = (quoted[0] + SPEECHLESS, quoted[1])
        cost, node = min(plain, quoted)
        before.append(node)
        if gap.cut < len(text):
            starts[text[gap.cut] in _QUOTES].add(cost - gap.evidence, j)
    cuts: list[int] = []
    j = len(gaps) - 1
    while j >= 0:
        cuts.append(gaps[j].cut)
        j = before[j]
    out: list[str] = []
    start = 0
    for c in reversed(cuts):
        s = text[start:c].strip()
        if s:
            out.append(s)
        start = c
    return out


# ---- what the sender wrote --------------------------------------------------------------------

_SEPARATOR = re.compile(r"^\s*(?:[-–—]{2,}|_{2,})\s*$")
_ORIGINAL = re.compile(
    r"^\s*[-_*=]{2,}\s*(?:original message|forwarded message|forwarded by|begin forwarded message|ursprüngliche nachricht|originalnachricht|weitergeleitete nachricht|message d'origine|message original|message transféré|message initial|mensaje original|mensaje reenviado|исходное сообщение|пересылаемое сообщение|転送|原始邮件|转发)[^\n]*$|^begin forwarded message:\s*$",
    re.I,
)
_DATE = r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}|\d{1,2}:\d{2}|\b\d{4}\b"
_INTRO = re.compile(rf"^(?=.*(?:{_DATE}|<\S+@\S+>))(?:(?:On|Am|El|Le|Il|Em|Op)\b.*\b(?:wrote|schrieb|escribió|écrit|scritto|escreveu|schreef)\b.{{0,80}}:|.*\b(?:wrote|schrieb|escribió|écrit)\b.{{0,60}}:)\s*$|^.*(?:写道|さんは書きました|пишет|написал\w*|كتب|ने लिखा|เขียนว่า)\s*[:：]\s*$")
_INTRO_HEAD = re.compile(rf"^(?:On|Am|El|Le) .*(?:{_DATE})\S*,?\s*$")
_WS = re.compile(r"\s+")


def _without_quotes(lines: list[str]) -> list[str]:
    """Own lines of a plain body; quotes become blank lines, the rest after a forward or signature is cut."""
    out: list[str] = []
    for line in lines:
        if line.startswith(">"):
            out.append("")
            continue
        if _SEPARATOR.match(line) or _ORIGINAL.match(line):
            break
        if line.rstrip().endswith((":", "：")) and _INTRO.match(line):
            if out and _INTRO_HEAD.match(out[-1]):
                out[-1] = ""
            out.append("")
            continue
        out.append(line)
    return out


def plain_paragraphs(body: str) -> list[str]:
    """Paragraphs the sender wrote in a plain body, white space collapsed."""
    out: list[str] = []
    held: list[str] = []
    for line in [*_without_quotes(body.split("\n")), ""]:
        if line.strip():
            held.append(line)
        elif held:
            out.append(_WS.sub(" ", " ".join(held)).strip())
            held = []
    return out


def html_paragraphs(body: str) -> list[str]:
    """Paragraphs the sender wrote in an HTML body; its blocks end paragraphs."""
    out: list[str] = []
    depth = 0
    for block in html_text(body).split(BLOCK_END):
        if block == QUOTE_OPEN:
            depth += 1
        elif block == QUOTE_CLOSE:
            depth = max(0, depth - 1)
        elif depth == 0 and block.strip():
            lines = [x.strip() for x in block.split("\n")]
            first = next((x for x in lines if x), "")
            if _SEPARATOR.match(first):
                break
            if _ORIGINAL.match(first):
                break
            cut = next((i for i, x in enumerate(lines) if x and (_SEPARATOR.match(x) or _ORIGINAL.match(x))), None)
            out += plain_paragraphs("\n".join(lines))
            if cut is not None:
                break
    return out


def sender_paragraphs(message: str | None) -> list[str]:
    """Paragraphs of a message's own body: the first plain part that is not attached, else the first HTML part."""
    parts = [p for p in text_parts(message) if not p.attached]
    part = next((p for p in parts if p.kind == "text/plain"), None) or next(iter(parts), None)
    if part is None:
        return []
    return plain_paragraphs(part.text) if part.kind == "text/plain" else html_paragraphs(part.text)


def sentences(message: str | None) -> list[str]:
    """Sentences of a message in order; null, empty or undecodable messages give none."""
    return [s for p in sender_paragraphs(message) for s in split_paragraph(p)]


def message_sentences(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, sentence``: each distinct sentence the sender of a message wrote.

    Whole messages are read, one at a time; no shuffle is needed because a
    message is one row. Null or empty texts give no rows, repeated rows are
    repeated in the result, other columns are dropped.
    """
    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    out_type = T.StructType([T.StructField("doc_id", src.schema["doc_id"].dataType), T.StructField("sentence", T.StringType())])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at: list[int] = []
            found: list[str] = []
            ids = b.column(0)
            for i, message in enumerate(b.column(1)):
                own = dict.fromkeys(sentences(message.as_py()))
                found += own
                at += [i] * len(own)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(at, pa.int64())), pa.array(found, pa.string())], names=["doc_id", "sentence"])

    return src.mapInArrow(split, out_type)
