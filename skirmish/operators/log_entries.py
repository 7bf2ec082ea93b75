"""Mixed program logs into entries: stamp, level, component, message.

Layouts are mined, only the notation of stamps is known beforehand. The words and marks around
the stamps of a file are counted by position, and frequent ones become the templates of the
file's programs: what is constant there are marks, what varies are slots (level by
vocabulary, component by its place). JSON and key=value lines are counted by key
instead of by place. Lines that fit no template of their file get one by its marks alone;
everything else (quoted or indented copies, stack traces, stamps that do not exist) continues
the entry before it.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from skirmish.functions.arrow import grouped
from skirmish.functions.times import from_wall_seconds
from skirmish.functions.staging import staged
from skirmish.session import cut_lineage

# A file uses a layout that this share of its heads has, or this many of them.
SUPPORT = 0.01
LEAST_HEADS = 5
# A branch of a template is followed if its continuations hold WHOLE of its lines, each at least BRANCH of them.
WHOLE = 0.9
BRANCH = 0.05
LINES_PER_CHUNK = 65_536
SALTS = 16

# Month and weekday abbreviations, the level words of logging libraries, and the usual
# names of keys, tried in this order.
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
WEEKDAYS = ["Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun"]
LEVELS = {
    "trace": ["trace", "trc", "verbose", "vrb", "t", "v", "finest", "finer"],
    "debug": ["debug", "dbg", "d", "fine"],
    "info": ["info", "inf", "information", "notice", "i"],
    "warn": ["warn", "wrn", "warning", "w"],
    "error": ["error", "err", "e", "severe"],
    "fatal": ["fatal", "ftl", "critical", "crit", "crt", "f", "emerg", "alert", "panic"],
}
STAMP_KEYS = ["ts", "time", "timestamp", "@timestamp", "datetime", "date", "at", "t"]
LEVEL_KEYS = ["level", "severity", "lvl", "loglevel", "priority"]
COMPONENT_KEYS = ["component", "logger", "module", "service", "source", "app", "program", "unit", "name", "category", "class", "caller"]
MESSAGE_KEYS = ["message", "msg", "text", "event"]

_LONG = [w for ws in LEVELS.values() for w in ws if len(w) > 1]
_LETTERS = [w.upper() for ws in LEVELS.values() for w in ws if len(w) == 1]
_MON = "|".join(MONTHS)
_DAY = "|".join(WEEKDAYS)
# The notations of stamps; field names: y mo d h mi s, yy (year of two digits), ap (AM/PM), mon (month
# name), wd (weekday name), ms and es (epoch milliseconds and seconds). A missing year comes from the path.
STAMPS = [
    (rf"({_DAY}),? ({_MON}) ([ \d]?\d) (\d\d):(\d\d):(\d\d)(?: [A-Z]{{3,4}})? (\d{{4}})", ("wd", "mon", "d", "h", "mi", "s", "y")),
    (r"(\d{4})[-/.](\d\d?)[-/.](\d\d?)[T ](\d\d?):(\d\d):(\d\d)", ("y", "mo", "d", "h", "mi", "s")),
    (r"(\d{4})(\d\d)(\d\d)[T -](\d\d):?(\d\d):?(\d\d)", ("y", "mo", "d", "h", "mi", "s")),
    (rf"(\d\d?)[-/ ]({_MON})[-/ ](\d{{4}})[: ](\d\d?):(\d\d):(\d\d)", ("d", "mon", "y", "h", "mi", "s")),
    (r"(\d\d?)/(\d\d?)/(\d{4}),? (\d\d?):(\d\d):(\d\d)(?: ([AP]M))?", ("mo", "d", "y", "h", "mi", "s", "ap")),
    (r"(\d\d?)\.(\d\d?)\.(\d{4}),? (\d\d?):(\d\d):(\d\d)", ("d", "mo", "y", "h", "mi", "s")),
    (r"(\d\d)/(\d\d)/(\d\d) (\d\d):(\d\d):(\d\d)", ("yy", "mo", "d", "h", "mi", "s")),
    (rf"({_MON}) {{1,2}}(\d\d?)(?:,? (\d{{4}}))?,? (\d\d):(\d\d):(\d\d)", ("mon", "d", "y", "h", "mi", "s")),
    (r"(\d{13})", ("ms",)),
    (r"(\d{10})", ("es",)),
]
_PARTS = ["y", "yy", "mo", "d", "h", "mi", "s", "ap", "mon", "wd", "ms", "es"]
_SEP = "\u0001"
_CORE = "(?:" + "|".join(p for p, _ in STAMPS) + ")"
_TAIL = r"(?:[.,]\d+)?(?: ?(?:Z|UTC|GMT|[+-]\d\d:?\d\d)(?![\p{L}\p{N}]))?(?![\p{L}\p{N}])"
# What may stand before a stamp: a level, the three words of an access log, one run of marks and words.
_BEFORE = rf"(?![\s>\"'`|])((?:[\[(<]?(?:{'|'.join(w.upper() for w in _LONG)})[\])>]?[:|,-]? +)?(?:\S++ \S++ \S++ (?=\[))?\S*?(?<![\p{{L}}\p{{N}}]))"
_HEAD = f"(?s)^{_BEFORE}({_CORE}){_TAIL}(.*)$"
_WHOLE_STAMP = f"^{_CORE}{_TAIL}$"
_WORD = r"[\p{L}\p{N}_](?:[\p{L}\p{N}_.$@+-]*[\p{L}\p{N}_$])?"
_MARK = r"[\[\](){}<>|:;,=/#*-]"
# Behind a stamp: words, at most two between marks, and the first words of what follows.
_REGION = rf"^(?:\s*+(?:{_WORD}(?:\s++{_WORD})?)?+\s*+{_MARK})*+(?:\s*+{_WORD}){{0,2}}"
_PAIR = r"([A-Za-z_@][\w.@-]*)=(\"(?:[^\"\\]|\\.)*+\"|[^\s\"]*+)"
_CLOSERS = frozenset("])>|:-;,")
_ENDS = frozenset(":-")
STAMP = "\u0002"


def clean_line(raw: Column) -> Column:
    """A line without byte-order mark, leading colour codes and trailing carriage return or colour reset."""
    lead = F.regexp_replace(raw, "^\\x{FEFF}?(?:\\x1b\\[[0-9;]*m)*", "")
    plain = F.regexp_replace(lead, "(?:\\x1b\\[[0-9;]*m)*\\r?$", "")
    return F.when(raw.contains("\x1b") | raw.startswith("\ufeff") | raw.endswith("\r"), plain).otherwise(raw)


def _number(names: list[str], c: Column) -> Column:
    m = F.create_map(*[x for i, n in enumerate(names, 1) for x in (F.lit(n), F.lit(i))])
    return F.element_at(m, c)


def _rewritten(text: Column) -> Column:
    """The parts of the stamp a line begins with, between separators: what is before, _PARTS, the stamp, what is behind; else anything without separators."""
    group, where = 3, defaultdict(list)
    for _, fields in STAMPS:
        for f in fields:
            where[f].append(f"${group}")
            group += 1
    # of the alternatives only the one that matched has text in its groups
    template = _SEP.join(["$1", *["".join(where[p]) for p in _PARTS], "$2", f"${group}"])
    may = F.substring(text, 1, 1).rlike(r"[^\s>\"'`|]") & text.rlike(r"\d:\d\d|\d{10}|\dT\d{6}")
    return F.when(may, F.regexp_replace(text, _HEAD, template))


def with_stamp(df: DataFrame, told: str, path: str, out: str) -> DataFrame:
    """Add ``at``, the parts of a stamp rewritten in ``told``, and ``out``, its TIMESTAMP_NTZ: null if it does not exist or its weekday is wrong."""
    df = staged(df, {"at": F.when(F.col(told).contains(_SEP), F.split(told, _SEP))}).drop(told)
    part = {p: F.nullif(F.element_at("at", i), F.lit("")) for i, p in enumerate(_PARTS, 2)}
    clock = part["h"].cast("int")
    hour = F.when(part["ap"].isNull(), part["h"]).when((clock >= 1) & (clock <= 12), (clock % 12 + F.when(part["ap"] == "PM", 12).otherwise(0)).cast("string"))
    month = F.coalesce(part["mo"], _number(MONTHS, part["mon"]).cast("string"))
    year = F.coalesce(part["y"], F.concat(F.lit("20"), part["yy"]), F.nullif(F.regexp_extract(path, r"/(\d{4})/", 1), F.lit("")))
    colon, dash = F.lit(":"), F.lit("-")
    printed = F.concat(year, dash, month, dash, F.trim(part["d"]), F.lit(" "), hour, colon, part["mi"], colon, part["s"]).try_cast("timestamp_ntz")
    # 946684800: the epoch second of 2000-01-01
    utc = from_wall_seconds(F.coalesce(F.floor(part["ms"].try_cast("bigint") / 1000), part["es"].try_cast("bigint")) - 946_684_800)
    df = staged(df, {"__at": F.when(F.col("at").isNotNull(), F.coalesce(printed, utc))})
    right_day = part["wd"].isNull() | (_number(WEEKDAYS, part["wd"]) == F.weekday(F.to_date("__at")) + 1)
    return staged(df, {out: F.when(F.col("__at").isNotNull() & right_day, F.col("__at"))}).drop("__at")


def _shape(stamp: Column) -> Column:
    """A stamp with every number as ``0`` and every word as ``a``."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(stamp, r"\d+", "0"), r"\p{L}+", "a"), " +", " ")


def _tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"({_WORD}|\S)"), F.lit(1))


def _sort_of(t: Column) -> Column:
    """What a token is: L level, l a level's letter, N number, T thread, X compound name, W word, else the mark itself."""
    return (
        F.when(F.lower(t).isin(_LONG), "L")
        .when(F.length(t) == 1, F.when(t.isin(_LETTERS), "l").when(t.rlike(r"\p{N}"), "N").when(t.rlike(r"[\p{L}_]"), "W").otherwise(t))
        .when(F.translate(t, "0123456789.+-", "") == "", "N")
        .when(t.rlike(r"^(?:main|[Tt]hread.*|.*[-#]\d+)$"), "T")
        .when(t.rlike(r"[._$-]|\p{Ll}\p{Lu}"), "X")
        .otherwise("W")
    )


def _keyed(text: Column) -> tuple[Column, Column]:
    """Keys and values (as text, quotes undone) of a JSON or key=value line; null for other lines."""
    json = F.when(text.startswith("{") & text.endswith("}"), F.from_json(text, "map<string,string>"))
    plain = F.when(text.rlike(r"^[A-Za-z_@][\w.@-]*="), text)
    values = F.transform(F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(2)), lambda v: F.when(v.startswith('"'), F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r'\\(["\\])', "$1")).otherwise(v))
    return F.coalesce(F.map_keys(json), F.regexp_extract_all(plain, F.lit(_PAIR), F.lit(1))), F.coalesce(F.map_values(json), values)


def _pairs(keys: Column, values: Column) -> Column:
    """``key, sort, value`` of each key: sort s stamp, l level, n name (all with their value), - anything else."""

    def told(k: Column, v: Column) -> Column:
        v = F.coalesce(v, F.lit(""))
        sort = F.when(F.lower(v).isin(_LONG), "l").when(v.rlike(_WHOLE_STAMP), "s").when(v.rlike(r"^[\p{L}_][\p{L}\p{N}_.$/:@-]*$"), "n").otherwise("-")
        return F.struct(k.alias("key"), sort.alias("sort"), F.when(sort != "-", v).alias("value"))

    return F.zip_with(keys, values, told)


def read_heads(lines: DataFrame) -> DataFrame:
    """``log_id, line_no, form, entry_ts, shape, pattern, words, pairs``: the lines that may open an entry, each once.

    ``lines`` has ``log_id, file_path, line_no, raw``. Plain lines come with their valid stamp, its shape, and the
    words and marks around it (``pattern``: their sorts); keyed lines with their pairs.
    Only these narrow rows are shuffled.
    """
    src = lines.select("log_id", "file_path", F.col("line_no").cast("int").alias("line_no"), F.coalesce("raw", F.lit("")).alias("raw")).where("log_id is not null and line_no is not null")
    line, reserved = clean_line(F.col("raw")), _SEP + STAMP
    holds = F.col("raw").contains(_SEP) | F.col("raw").contains(STAMP)
    plain = F.when(holds, F.translate(line, reserved, "  ")).otherwise(line)
    text = staged(src, {"text": plain}).drop("raw")
    keys, values = _keyed(F.col("text"))
    looks_keyed = F.col("text").startswith("{") | F.col("text").contains("=")
    split = staged(text, {"told": _rewritten(F.col("text")), "keys": F.when(looks_keyed, keys), "values": F.when(looks_keyed, values)})
    is_keyed = F.size("keys") > 0
    split = staged(split, {"pairs": F.when(is_keyed, _pairs(F.col("keys"), F.col("values"))), "told": F.when(~F.coalesce(is_keyed, F.lit(False)), F.col("told"))})
    read = with_stamp(split, "told", "file_path", "entry_ts")
    read = read.where(F.col("entry_ts").isNotNull() | F.exists("pairs", lambda p: p["sort"] == "s"))
    n = len(_PARTS)
    words = F.concat(_tokens(F.element_at("at", 1)), F.array(F.lit(STAMP)), _tokens(F.regexp_extract(F.element_at("at", n + 3), f"({_REGION})", 1)))
    read = staged(read, {"words": F.when(F.col("entry_ts").isNotNull(), words)})
    form = F.when(F.col("entry_ts").isNotNull(), "plain").when(F.col("text").startswith("{"), "json").otherwise("pairs")
    pattern = F.array_join(F.transform("words", _sort_of), " ")
    stamp = F.when(F.col("entry_ts").isNotNull(), _shape(F.element_at("at", n + 2)))
    rows = read.select("log_id", "line_no", "file_path", form.alias("form"), "entry_ts", stamp.alias("shape"), pattern.alias("pattern"), "words", F.filter("pairs", lambda p: p["sort"] != "-").alias("pairs"), F.transform("pairs", lambda p: p["key"]).alias("keys"))
    once = rows.groupBy("log_id", "line_no").agg(F.min(F.struct("file_path", "form", "entry_ts", "shape", "pattern", "words", "pairs", "keys")).alias("h"))
    return once.select("log_id", "line_no", "h.*")


def position_counts(heads: DataFrame) -> DataFrame:
    """``log_id, form, shape, pattern, key, n, stamps, levels, names``: how often what stands around stamps, or under keys, of a file."""
    zero = F.lit(0).cast("bigint")
    plain = heads.where("form = 'plain'").groupBy("log_id", "form", "shape", "pattern").agg(F.count(F.lit(1)).alias("n")).select("log_id", "form", "shape", "pattern", F.lit(None).cast("string").alias("key"), "n", *[zero.alias(c) for c in ("stamps", "levels", "names")])
    keyed = heads.where("form <> 'plain'")
    sorts = keyed.select("log_id", "form", F.explode("pairs").alias("p")).select("log_id", "form", "p.key", "p.sort").unionByName(keyed.select("log_id", "form", F.explode("keys").alias("key"), F.lit("").alias("sort")))
    by_key = sorts.groupBy("log_id", "form", "key").agg(F.count_if(F.col("sort") == "").alias("n"), *[F.count_if(F.col("sort") == s).alias(c) for s, c in (("s", "stamps"), ("l", "levels"), ("n", "names"))])
    return plain.unionByName(by_key, allowMissingColumns=True)


# ---- templates of one file, from its counts -------------------------------------------------------


def _cuts(sorts: tuple[str, ...]) -> list[int]:
    """Where a head may end: behind the closing marks of a slot, behind the stamp, behind a bare level."""
    out, slot, i = [], False, 0
    while i < len(sorts):
        if sorts[i] in _CLOSERS and slot:
            while i + 1 < len(sorts) and sorts[i + 1] in _CLOSERS:
                i += 1
            out.append(i + 1)
            slot = False
        elif sorts[i] in (STAMP, "L") and (i + 1 == len(sorts) or sorts[i + 1] not in _CLOSERS):
            out.append(i + 1)
            slot = False
        else:
            slot = slot or sorts[i] in (STAMP, "L", "l", "N", "w")
        i += 1
    return out


def _slots(sorts: tuple[str, ...], thread: list[float]) -> tuple[int | None, int | None]:
    """Places of level and component in a template; ``thread`` is the share of thread names at each place."""
    level = next((i for i, t in enumerate(sorts) if t == "L"), None)
    if level is None:
        level = next((i for i, t in enumerate(sorts[:-1]) if t == "l" and sorts[i + 1] in "/])|:"), None)
    names = [i for i, t in enumerate(sorts) if t in ("w", "l") and i != level]
    return level, next(reversed([i for i in names if thread[i] < 0.5] or names), None)


def templates(patterns: dict[str, int]) -> dict[str, tuple[int, int | None, int | None]]:
    """``(length of the head, place of the level, of the component)`` for every pattern of one stamp's shape in a file.

    The patterns are followed from the left, one closed slot at a time, as long as the lines agree on
    how it goes on; the rest is message. A pattern that leaves the agreement takes the commonest template with
    its marks, else the part it shares.
    """
    raw = {p: tuple(p.split(" ")) for p in patterns}
    sorts = {p: tuple("w" if t in ("W", "X", "T") else t for t in ts) for p, ts in raw.items()}
    cuts = {p: _cuts(ts) for p, ts in sorts.items()}
    ends: dict[str, int] = {}
    agreed: set[str] = set()
    todo = [(list(patterns), 0, 0)]
    while todo:
        group, depth, length = todo.pop()
        total = sum(patterns[p] for p in group)
        children = defaultdict(list)
        for p in group:
            ends[p] = length
            if depth < len(cuts[p]):
                children[sorts[p][length : cuts[p][depth]]].append(p)
        weight = {c: sum(patterns[p] for p in ps) for c, ps in children.items()}
        before = [sorts[group[0]].index(STAMP) >= length] if group else []
        common = [c for c in children if any(before) or weight[c] >= BRANCH * total]
        closed = length and not any(before) and any(t in _ENDS for t in sorts[group[0]][length - 2 : length]) and any(t == "w" for t in sorts[group[0]][sorts[group[0]].index(STAMP) : length])
        # a level may still follow the component
        led_by_level = sum(weight[c] for c in children if "L" in c[:2]) >= WHOLE * total
        if (closed and not led_by_level) or not common or (not any(before) and sum(weight[c] for c in common) < WHOLE * total):
            agreed.update(group)
            continue
        for c in common:
            todo.append((children[c], depth + 1, length + len(c)))
    by_template: Counter = Counter()
    for p in agreed:
        by_template[sorts[p][: ends[p]]] += patterns[p]
    threads, compound = defaultdict(Counter), defaultdict(int)
    for p in agreed:
        t = sorts[p][: ends[p]]
        for i, sort in enumerate(raw[p][: ends[p]]):
            threads[t][i] += patterns[p] * (sort == "T")
        compound[t] += patterns[p] * (raw[p][ends[p] : ends[p] + 1] == ("X",))
    known = {}
    for t, n in by_template.items():
        level, component = _slots(t, [threads[t][i] / n for i in range(len(t))])
        # a name of dotted or compound words right behind a bare level is its component
        bare = component is None and level is not None and level == len(t) - 1 and compound[t] >= WHOLE * n
        known[t] = (len(t) + 1, level, len(t)) if bare else (len(t), level, component)

    def marks(ts: tuple[str, ...]) -> tuple[str, ...]:
        return tuple("x" if t in ("L", "l", "N", "w") else t for t in ts)

    ranked = sorted(by_template, key=lambda t: (-by_template[t], t))
    out = {}
    for p in patterns:
        t = sorts[p][: ends[p]]
        if p not in agreed:
            t = next((k for k in ranked if marks(sorts[p][: len(k)]) == marks(k)), t)
        out[p] = known.get(t) or (len(t), *_slots(t, [0.0] * len(t)))
    return out


def _best(keys: dict[str, tuple[int, int]], usual: list[str]) -> list[str]:
    """Keys whose values nearly all are of a sort, usual names first, then by count; ``keys``: of the sort, all."""
    fit = [k for k, (n, total) in keys.items() if n and n >= WHOLE * total]
    return sorted(fit, key=lambda k: (usual.index(k.lower()) if k.lower() in usual else len(usual), -keys[k][0], k))


_TEMPLATE = "log_id string, form string, shape string, pattern string, head int, level_at int, component_at int, stamp_keys array<string>, level_key string, component_key string, message_key string"
_COUNTED = ["form", "shape", "pattern", "key", "n", "stamps", "levels", "names"]


def mine(counts: list[tuple], support: float) -> list[dict]:
    """Templates of the layouts that one file uses, from its :func:`position_counts` (rows of _COUNTED).

    A layout is the shape of a stamp with the marks before it, or a set of keys. Those that neither ``support`` of the
    file's heads nor LEAST_HEADS of them have are no layout of a program of this file.
    """
    layouts: dict = defaultdict(dict)
    keyed: dict = defaultdict(dict)
    for form, shape, pattern, key, *n in counts:
        if form == "plain":
            before = tuple("x" if len(t) == 1 and t.isalpha() else t for t in pattern.split(STAMP)[0].split(" "))
            layouts[shape, before][pattern] = n[0]
        else:
            keyed[form][key] = n
    stamps = {form: _best({k: (n[1], n[0]) for k, n in keys.items()}, STAMP_KEYS) for form, keys in keyed.items()}
    used = {layout: sum(patterns.values()) for layout, patterns in layouts.items()}
    used |= {form: max((keyed[form][k][0] for k in ks), default=0) for form, ks in stamps.items()}
    total = sum(used.values())
    used = {k for k, n in used.items() if n and (n >= LEAST_HEADS or n >= support * total)}
    out = []
    for layout in used & layouts.keys():
        for pattern, (head, level, component) in templates(layouts[layout]).items():
            out.append(dict(form="plain", shape=layout[0], pattern=pattern, head=head, level_at=level, component_at=component))
    for form in used & keyed.keys():
        keys = keyed[form]
        level = next(iter(_best({k: (n[2], n[0]) for k, n in keys.items()}, LEVEL_KEYS)), None)
        taken = {*stamps[form], level}
        message = next((k for m in MESSAGE_KEYS for k in sorted(keys) if k.lower() == m), None)
        names = _best({k: (n[3], n[0]) for k, n in keys.items()}, COMPONENT_KEYS)
        component = next((k for k in names if k not in taken and k.lower() not in MESSAGE_KEYS), None)
        out.append(dict(form=form, stamp_keys=stamps[form], level_key=level, component_key=component, message_key=message))
    return out


def mined(counts: DataFrame, support: float) -> DataFrame:
    """Templates of every file; a task takes its files one after the other."""
    out_type = T._parse_datatype_string(_TEMPLATE)
    arrow = to_arrow_schema(out_type)

    def by_file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts, ends in grouped(batches, ["log_id"]):
            logs, cols = t.column("log_id").to_pylist(), [t.column(c).to_pylist() for c in _COUNTED]
            rows = [dict(r, log_id=logs[s]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) for r in mine(list(zip(*[c[s:e] for c in cols], strict=True)), support)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return counts.repartition("log_id").sortWithinPartitions("log_id").mapInArrow(by_file, out_type)


def entry_heads(lines: DataFrame, support: float = SUPPORT) -> DataFrame:
    """The lines that open an entry: ``log_id, line_no, entry_ts, log_level, component, form, slots`` and the keys of keyed ones.

    The scan is read once; heads, without their text, are written to the shared folder. Their counts per
    file are small (patterns and keys, not lines) and are turned into templates file by file. The join with
    the templates is salted by line number because a file may hold a third of all
    lines. ``slots`` is the number of words and marks behind the stamp that belong to the head.
    """
    heads = cut_lineage(read_heads(lines))
    found = cut_lineage(mined(position_counts(heads), support)).select("*", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    salted = heads.withColumn("salt", F.pmod("line_no", F.lit(SALTS)))
    levels = F.create_map(*[x for level, ws in LEVELS.items() for w in ws for x in (F.lit(w), F.lit(level))])

    def level(word: Column) -> Column:
        return F.coalesce(F.element_at(levels, F.lower(word)), F.lit(""))

    plain = salted.where("form = 'plain'").join(found.where("form = 'plain'").drop("form"), ["log_id", "shape", "pattern", "salt"])
    plain = plain.select("log_id", "line_no", "entry_ts", level(F.get("words", F.col("level_at"))).alias("log_level"), F.coalesce(F.get("words", F.col("component_at")), F.lit("")).alias("component"), "form", (F.col("head") - F.array_position("words", STAMP)).cast("int").alias("slots"))

    def value(key: Column) -> Column:
        return F.get(F.filter("pairs", lambda p: p["key"] == key), F.lit(0))

    keyed = salted.where("form <> 'plain'").join(found.where("form <> 'plain'").drop("shape", "pattern"), ["log_id", "form", "salt"])
    stamp_key = F.get(F.filter("stamp_keys", lambda k: F.exists("pairs", lambda p: (p["key"] == k) & (p["sort"] == "s"))), F.lit(0))
    keyed = staged(staged(keyed, {"stamp_key": stamp_key}), {"told": _rewritten(value(F.col("stamp_key"))["value"])})
    keyed = with_stamp(keyed, "told", "file_path", "ts").where("ts is not null")
    keyed = keyed.select(
        "log_id", "line_no", F.col("ts").alias("entry_ts"), level(value(F.col("level_key"))["value"]).alias("log_level"), F.coalesce(value(F.col("component_key"))["value"], F.lit("")).alias("component"), "form",
        F.array_compact(F.array("stamp_key", "level_key", "component_key")).alias("head_keys"), "message_key",
    )
    return plain.unionByName(keyed, allowMissingColumns=True)


def without_head(text: Column, form: Column, slots: Column, head_keys: Column, message_key: Column) -> Column:
    """The message of an opening line: what its template does not name as stamp, level or component.

    A JSON line with more keys than these and its message stays as printed, as does what a
    key=value line has beside its message.
    """
    skip = F.concat(F.lit(rf"^(?:\s*(?:{_WORD}|\S)){{"), F.coalesce(slots, F.lit(0)).cast("string"), F.lit("}"))
    plain = F.regexp_replace(F.regexp_replace(text, _HEAD, f"${sum(len(f) for _, f in STAMPS) + 3}"), skip, F.lit(""))
    keys, values = _keyed(text)
    told = F.get(values, (F.array_position(keys, message_key) - 1).cast("int"))
    rest = F.array_except(keys, head_keys)
    only = (F.size(rest) == 1) & (F.get(rest, F.lit(0)) == message_key) & told.isNotNull()
    cut = F.regexp_replace(text, F.concat(F.lit(r"(?:^|(?<=\s))(?:"), F.array_join(head_keys, "|"), F.lit(r")=(?:\"(?:[^\"\\]|\\.)*+\"|[^\s\"]*+)(?:\s+|$)")), F.lit(""))
    return F.ltrim(F.when(form == "plain", plain).when(only, told).when(form == "pairs", cut).otherwise(text))


def log_entries(lines: DataFrame, support: float = SUPPORT, with_message: bool = True, cut_head: bool = False) -> DataFrame:
    """One row per entry: ``log_id, first_line, last_line, entry_ts, log_level, component[, message]``.

    ``lines`` has ``log_id, file_path, line_no, raw``. An entry runs to the line before the next
    one of its file or to the file's last line; lines before the first entry belong to none. The
    message is the opening line as printed (with ``cut_head`` without stamp, level and component)
    followed by the lines that continue it, joined by line feeds. Repeated keys count once (the smallest text); a null text is an empty line; rows
    without a log_id or line_no are dropped; an empty table gives no rows.

    Windows run per (file, chunk of LINES_PER_CHUNK lines), so a file that holds a third of
    all lines is spread over its chunks; what crosses chunks is one number each. The narrow
    heads are written to the shared folder once, as several steps read them.
    """
    chunk = F.expr(f"line_no div {LINES_PER_CHUNK}").cast("int").alias("chunk")
    heads = cut_lineage(entry_heads(lines, support).select("*", chunk))
    inside = Window.partitionBy("log_id", "chunk").orderBy("line_no")
    later = Window.partitionBy("log_id").orderBy("chunk")
    ends = lines.where("log_id is not null").groupBy("log_id").agg(F.max(F.col("line_no").cast("int")).alias("end"))
    firsts = heads.groupBy("log_id", "chunk").agg(F.min("line_no").alias("first")).withColumn("next_chunk", F.lead("first").over(later))
    borders = firsts.join(ends, "log_id").select("log_id", "chunk", F.coalesce(F.col("next_chunk") - 1, F.col("end")).alias("border"))
    entries = (
        heads.withColumn("next", F.lead("line_no").over(inside))
        .join(borders, ["log_id", "chunk"])
        .select("log_id", F.col("line_no").alias("first_line"), F.coalesce(F.col("next") - 1, F.col("border")).alias("last_line"), "entry_ts", "log_level", "component")
    )
    if not with_message:
        return entries
    body = lines.where("log_id is not null and line_no is not null").select("log_id", F.col("line_no").cast("int").alias("line_no"), clean_line(F.coalesce("raw", F.lit(""))).alias("text"))
    body = body.groupBy("log_id", chunk, "line_no").agg(F.min("text").alias("text"))
    opened = body.join(heads.select("log_id", "chunk", "line_no", F.col("line_no").alias("start"), "form", "slots", "head_keys", "message_key"), ["log_id", "chunk", "line_no"], "left")
    if cut_head:
        opened = opened.withColumn("text", F.when(F.col("start").isNull(), F.col("text")).otherwise(without_head(*[F.col(c) for c in ("text", "form", "slots", "head_keys", "message_key")])))
    carried = heads.groupBy("log_id", "chunk").agg(F.max("line_no").alias("last_start"))
    every = body.select("log_id", "chunk").distinct().join(carried, ["log_id", "chunk"], "left")
    earlier = later.rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("log_id", "chunk", F.max("last_start").over(earlier).alias("carry"))
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    placed = opened.withColumn("own", F.max("start").over(so_far)).join(every, ["log_id", "chunk"]).select("log_id", F.coalesce("own", "carry").alias("first_line"), "line_no", "text")
    texts = placed.where("first_line is not null").groupBy("log_id", "first_line").agg(F.array_sort(F.collect_list(F.struct("line_no", "text"))).alias("body"))
    whole = texts.select("log_id", "first_line", F.array_join(F.transform("body", lambda x: x["text"]), "\n").alias("message"))
    return entries.join(whole, ["log_id", "first_line"])
