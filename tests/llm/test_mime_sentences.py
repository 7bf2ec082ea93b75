import base64

import pytest

from skirmish.llm.mime import decode_body, html_text, text_parts
from skirmish.llm.sentences import lattice_path, message_sentences, sentences, split_paragraph

MIXED = """From mira@x Mon Mar  4 00:00:00 2019
From: Mira <mira@kiln.invalid>
Content-Type: multipart/mixed;
 boundary="out er"
MIME-Version: 1.0

preamble
--out er
Content-Type: multipart/alternative; boundary=in

--in
Content-Type: text/plain; charset="utf-8"
Content-Transfer-Encoding: quoted-printable

Caf=C3=A9 is open. We me=
t there.
--in
Content-Type: text/html; charset=utf-8

<html><head><style>p {}</style></head><body><p>Caf&eacute; is <b>open</b>.</p></body></html>
--in--
--out er
Content-Type: text/plain; name=notes.txt
Content-Disposition: attachment; filename=notes.txt
Content-Transfer-Encoding: BASE64

bm90ZXMgaGVyZ
--out er
Content-Type: image/png
Content-Transfer-Encoding: base64

iVBORw0KGgo"""


def test_parts_of_a_damaged_message():
    for text in (MIXED, MIXED.replace("\n", "\r\n")):
        parts = [(p.kind, p.attached, p.text.strip()) for p in text_parts(text)]
        assert parts[0] == ("text/plain", False, "Café is open. We met there.")
        assert parts[1][0] == "text/html" and "<b>open</b>" in parts[1][2]
        assert parts[2] == ("text/plain", True, "notes her") and len(parts) == 3
    assert sentences(MIXED) == ["Café is open.", "We met there."]


def test_bodies_never_raise():
    assert decode_body("4pyT!!", "base64", "no-such-charset") == "✓"
    assert decode_body("=E9=ZZ", "quoted-printable", "iso-8859-1") == "é=ZZ"
    assert text_parts(None) == [] and text_parts("") == []
    for broken in ("Content-Type: multipart/mixed; boundary=x\n\n", "no headers at all", "\n\nbody", "A: b", "Content-Type: multipart/mixed\n\nx"):
        text_parts(broken)
    deep = "".join(f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n" for i in range(60))
    text_parts(deep)


def test_html_text_keeps_blocks():
    assert html_text("<p>a<br>b</p><script>x</script>c &amp; d").replace("\u0002", "|") == "|a\nb| c & d"


PARAGRAPHS = {
    "The officers met at 10 p.m. The U.S. and E.U. servers restart separately. No. 481 is unpaid.": 3,
    "It dropped 9.9 points (from 3.1 to 2.2), e.g. on Friday. Dr. Vexa and J. Bron left.": 2,
    "'It works on my machine,' said Bron. \"Are we wiping again?\" asked Mira before the pull. The answer was \"maybe.\" Bron wrote it.": 4,
    "Who lost the marker?! (Sorry for the late reply.) Hmm… the ferry looks cheap to me.The plan holds. raidBot went quiet.": 5,
    "Das sind z. B. 97 Treffer, d. h. 2,8 % mehr. Am 7. März kam er. „Kommt ihr noch?“, fragte Bron. Nr. 3 fehlt.": 4,
    "« On recommence ? » demanda Bron. Voir le chap. 8 du guide, p. 351. M. Bron a perdu 4 points, p. ex. hier.": 3,
    "«¿Otra vez?», dijo Bron. EE. UU. tiene otro servidor. El Sr. Bron llegó a las 9:30 p. m. con flechas.": 3,
    "Питомец снова пропал… См. стр. 857 и рис. 9. «Идём?» — спросил Bron. А. Б. Bron не пришёл.": 4,
    "昨夜のログは9行でした。「もう一度やる？」とBronが聞いた。「また明日。」集合は11:02です。": 4,
    "奇怪……日志里没有Bron的名字。“还要再来一次吗？”Bron问道。他说：“明天见。”他说：“明天见。”谁动了标记？": 5,
    "औसत 252.2 रहा। डॉ. Bron देर से आएँगे। “फिर से?” Bron ने पूछा। मार्कर किसने हटाया?": 4,
    "سأل Bron: «هل نعيد؟» ثم غادر. وصل د. Bron متأخرا. شكرا للجميع! من حرك العلامة؟": 4,
    "ขอบคุณทุกคนมากครับ พบกันเวลา 8:39 ที่ประตูนะครับ ค่าเฉลี่ยคือ 545.1 ครับ ใครย้ายเครื่องหมายคะ คุณ Bron จะมาสายค่ะ": 5,
    "Use build v9.1.2 from files.kiln.invalid, not http://x.y/page.html?id=7 or a@b.c today": 1,
    "": 0,
}


@pytest.mark.parametrize("text", PARAGRAPHS)
def test_paragraphs(text):
    got = split_paragraph(text)
    assert len(got) == PARAGRAPHS[text], got
    assert " ".join(got).replace(" ", "") == text.replace(" ", "")


def mail(body, kind="text/plain", encode=False):
    head = f"From: a@b.c\nContent-Type: {kind}; charset=utf-8\n"
    return head + ("Content-Transfer-Encoding: base64\n\n" + base64.encodebytes(body.encode()).decode() if encode else "\n" + body)


def test_only_the_senders_words_count():
    body = "Hi Bron,\n\nFirst line goes\non here. Second one\n\nOn Mon, Mar 4, 2019 at 14:22\nBron <bron@x.y> wrote:\n> quoted. text.\n>more\n\nThanks,\nMira\n-- \nMira Vexa\nTel. 1\n"
    want = ["Hi Bron,", "First line goes on here.", "Second one", "Thanks, Mira"]
    assert sentences(mail(body)) == want and sentences(mail(body, encode=True)) == want
    assert sentences(mail("Below.\n\n---------- Forwarded message ----------\nFrom: x\n\nOld text.\n")) == ["Below."]
    assert sentences(mail("Am 4.03.2019 9:10 schrieb Bron:\n>alt\nNeu hier.\n________________________________\nMira")) == ["Neu hier."]


def test_html_bodies():
    html = "<html><head><title>t.</title></head><body><p>One. Two</p><p>Three<br>more.</p><p>On 04.03.2019 04:23, Bron wrote:</p><blockquote><div>Old. Text.</div></blockquote><div>Four &amp; five.</div><div>-- <br>Mira<br>Tel. 1</div></body></html>"
    assert sentences(mail(html, "text/html")) == ["One.", "Two", "Three more.", "Four & five."]


def test_lattice_prefers_long_words():
    assert lattice_path("นะครับ", frozenset(["นะ", "ครับ", "นะครับ"])) == ["นะครับ"]
    assert lattice_path("xx問道", frozenset(["問道"])) == ["xx", "問道"]


def test_spark_operator(spark):
    long = mail("Word here. " * 40_000)
    rows = [(1, mail("One two. Three four. One two."), "s"), (2, None, "s"), (3, "", "s"), (4, long, "s"), (None, mail("Xyz."), "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, sentence string")
    got = sorted(((r.doc_id or 0), r.sentence) for r in message_sentences(df, "doc_id", "text").collect())
    assert got == [(0, "Xyz."), (1, "One two."), (1, "Three four."), (4, "Word here.")]
    assert message_sentences(df.limit(0), "doc_id", "text").count() == 0


@pytest.mark.parametrize(
    "text, n",
    [
        ("I lost the log :-( It was late. We go on. Bron came.", 3),
        ("That hurts :( Again. We go on :) Bron came. He left.", 3),
        ("See the list (page two. We go on. Bron came. He left.", 4),
        ("He said “wait. We go on. Bron came. “Really?” she asked. He left.", 5),
        ("Il dit « attends. On continue. Bron vient.", 3),
        ("Er rief „Halt. Komm.” Dann ging er. Bron kam.", 3),
        ("Er rief »Halt«. Dann ging er. Bron sagte »Komm«. Alle gingen.", 4),
        ("他说“等等。我们走了。大家来了。", 3),
        ("He wrote (it was late. We knew.) that day. Bron came.", 2),
    ],
)
def test_openers_without_a_partner_block_nothing(text, n):
    got = split_paragraph(text)
    assert len(got) == n, got
    assert "".join("".join(got).split()) == "".join(text.split())


@pytest.mark.parametrize(
    "text, n",
    [
        ("งานเสร็จแล้ว เขากลับบ้านแล้ว ผมยังอยู่แล้ว เรารอ", 4),
        ("บริษัทรายงานผลประกอบการ ดังนั้นราคาหุ้นสูงขึ้น นอกจากนี้ยังมีเงินปันผล", 3),
        ("เขากล่าวว่า ดังนั้นต้องรอ", 1),
        ("“还要再来一次吗？”" + "站在门口的那个穿着红色外套的高个子年轻人转过身来看着所有在场的客人和他们的孩子以及远处的山" + "问道。他走了。", 2),
    ],
)
def test_openers_and_whole_runs(text, n):
    got = split_paragraph(text)
    assert len(got) == n, got


# Sentences no list was written for, each with its boundaries marked by a bar.
HELD_OUT = [
    "ฉันชอบกินข้าวผัด |แมวของฉันชอบนอนกลางวัน",
    "พ่อทำงานที่ธนาคาร |แม่ขายผลไม้ในตลาด |น้องกำลังเรียนหนังสือ",
    "ถ้าฝนตก เราจะไม่ไปทะเล |พรุ่งนี้อากาศจะดี",
    "เขาบอกว่า ไม่มีเวลา |เราต้องรอจนถึงเย็น",
    "รถไฟออกแล้ว |เรามาไม่ทัน |ดังนั้นต้องรอคันต่อไป",
    "ร้านนี้ขายของแพง |คนไม่ค่อยมาซื้อ",
    "今朝は雨が降っていた。|電車が遅れたので、会社に遅刻した。|「大丈夫？」と部長に聞かれた。|明日は早く出よう！",
    "彼は「行かない。」と言った。|私は驚いた。",
    "今天天气很好。|我们去公园吧！|她问：“你吃饭了吗？”|他摇摇头。",
    "“快走！”老师喊道。|学生们跑了出去。",
    "ខ្ញុំទៅផ្សារព្រឹកនេះ។ |គាត់នៅផ្ទះ។ |តើអ្នកសុខសប្បាយទេ?",
    "ကျွန်တော်သွားမယ်။ |သူလာမယ်။ |စားပြီးပြီ။",
    "ཁྱེད་རང་ག་པར་འགྲོ། |ང་ཁྲོམ་ལ་འགྲོ།",
    "Բարեւ։ |Ինչպես ես։ |Լավ եմ։",
    "ሰላም ነው። |ደህና ነኝ።",
    "I met Adm. Hale on board. |We sailed at dawn (see p. 4). |“Land!” he cried. |Nobody slept.",
    "1. Open the door. |2. Walk in. |3. Close it.",
    "Il a dit « non. Jamais. » et il est parti. |Elle rit.",
]


def test_held_out_texts():
    """Boundaries of sentences the lists were not made from: recall and precision."""
    hit = wanted = given = 0
    for marked in HELD_OUT:
        want = {x.strip() for x in marked.split("|")}
        got = set(split_paragraph(marked.replace("|", "")))
        hit, wanted, given = hit + len(got & want), wanted + len(want), given + len(got)
    assert hit >= 0.9 * wanted and hit >= 0.9 * given, (hit, wanted, given)


def test_long_paragraphs_take_linear_time():
    import time

    for text in ("word one two. " * 8000, "(a. " * 8000, "a.b@c/" * 8000 + ".", "“x. " * 8000, "他说。" * 8000, "ฉันไป " * 8000):
        began = time.perf_counter()
        got = split_paragraph(text.strip())
        assert time.perf_counter() - began < 2 and "".join("".join(got).split()) == "".join(text.split())


def test_a_later_choice_revises_an_earlier_one():
    # without its closing mark the bracket is no pair, with it the boundary inside is given up
    assert len(split_paragraph("We left (it was late. We knew. Bron stayed.")) == 3
    assert len(split_paragraph("We left (it was late. We knew). Bron stayed.")) == 2


def test_parts_of_any_depth():
    inner = "Content-Type: text/plain\n\nDeep words."
    for i in range(60):
        inner = f"Content-Type: multipart/mixed; boundary=b{i}\n\n--b{i}\n{inner}\n--b{i}--\n"
    assert [(p.kind, p.attached, p.text.strip()) for p in text_parts("From: a@b.c\n" + inner)] == [("text/plain", False, "Deep words.")]
