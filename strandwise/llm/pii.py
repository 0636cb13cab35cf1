"""Personal data: regular kinds by pattern, unseen identifiers by bootstrapped contextual extraction.

Base spans come from fixed patterns with checks.  They are the seed instances of a graph of (lexical pattern,
instance) edges: a pattern is the word before or after a mention, an instance the text of a mention.  A pattern's
confidence is the share of all its occurrences in the corpus whose slot holds trusted instances, so everyday words
never become patterns; an instance that no base pattern accepts (an address without a domain suffix, a number that
fails its check) is trusted as far as its patterns are.  A few rounds let trust spread through the graph; then
instances above the threshold become spans of the kind that their shape and patterns agree on.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, materialize, running

KINDS = ("email", "ip", "card", "phone")

# The base patterns.  They match what the plain forms match; a start in the middle of a run that cannot
# match is not tried, and repeated groups are possessive, so that matching takes linear time and no stack.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Cheap conditions without which the pattern has no match that counts.
GATES: dict[str, Callable[[Column], Column]] = {
    "email": lambda t: t.contains("@"),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"),
    "phone": lambda t: t.rlike(r"\+[0-9]"),
}
#: What may be an identifier of some kind: an address of any form, or digits with the signs that group them.
CANDIDATE = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++|(?:(?<![A-Za-z0-9])|\G)[0-9](?:[().\x20-]{0,2}[0-9]){6,}+"
_BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
_BREAK = r"[\x20\x09-\x0D0-9@]"
_NEAR = 64

_MENTION = "array<struct<start:bigint,end:bigint,match:string,left:string,right:string>>"


def _bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.transform(F.array(value), use)[0]


def _word(near: Column, pattern: str, edge: str) -> Column:
    word = lower_ascii(F.regexp_extract(near, pattern, 1))
    return F.when(word == "", F.lit(edge)).otherwise(word)


def mentions(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with their code point spans and the words beside them.

    Splitting by the pattern gives the pieces between the matches; their lengths add up to the positions.
    """

    def place(parts: Column) -> Column:
        matches, pieces = parts["matches"], parts["pieces"]
        ends = running(F.zip_with(F.slice(pieces, 1, F.size(matches)), matches, lambda b, m: (F.char_length(b) + F.char_length(m)).cast("bigint")), lambda a, n: a + n, F.lit(0).cast("bigint"))
        rows = F.arrays_zip(matches.alias("m"), F.slice(pieces, 1, F.size(matches)).alias("before"), F.slice(pieces, 2, F.size(matches)).alias("after"), ends.alias("end"))
        return F.transform(rows, lambda x: F.struct(
            (x["end"] - F.char_length(x["m"])).alias("start"),
            x["end"].alias("end"),
            x["m"].alias("match"),
            _word(F.substring(x["before"], -_NEAR, _NEAR), f"({_BREAK.replace('[', '[^', 1)}++){_BREAK}*+$", "<").alias("left"),
            _word(F.substring(x["after"], 1, _NEAR), f"^{_BREAK}*+({_BREAK.replace('[', '[^', 1)}++)", ">").alias("right"),
        ))

    return _bind(F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), 0).alias("matches")), place)


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
    "card": lambda m: _bind(_digits(m), lambda d: F.when(F.length(d).between(13, 19), _luhn(d)).otherwise(False)),
    "phone": lambda m: F.length(_digits(m)).between(9, 15),
}


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda x: VALID[kind](x["match"])


def _as_seed(kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(kind).alias("kind"), F.lit(1.0).alias("seed"), m.alias("m"))


def _as_span(rank: int, kind: str) -> Callable[[Column], Column]:
    return lambda m: F.struct(F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end"))


def is_kind(kind: str) -> Callable[[Column], Column]:
    return lambda x: x["kind"] == kind


def _shape(match: Column) -> Column:
    """The kind that a candidate looks like."""
    n = F.length(_digits(match))
    return (
        F.when(match.contains("@"), "email")
        .when(match.rlike(r"^[0-9]++(?:\.[0-9]++){3,}+$"), "ip")
        .when((n >= 13) & ~match.contains("."), "card")
        .when(n <= 15, "phone")
    )


def base_mentions(docs: DataFrame, with_row: bool = False) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, all) per row, written: arrays of mentions; ``all`` holds candidates of any
    form.  ``key`` stands for the id and the text.  ``with_row`` adds the row of docs as ``row``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    row = [F.struct(*docs.columns).alias("row")] if with_row else []
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *row)
    none = F.array().cast(_MENTION)
    found = rows.select(
        "doc_id",
        F.xxhash64("doc_id", "text").alias("key"),
        *(
            F.when(GATES[k](F.col("text")), F.filter(mentions(F.col("text"), PATTERNS[k]), _passes(k))).otherwise(none).alias(k)
            for k in KINDS
        ),
        F.when(F.col("text").rlike("[0-9]{2}|@"), mentions(F.col("text"), CANDIDATE)).otherwise(none).alias("all"),
        *(["row"] if with_row else []),
    )
    # written before the arrays are used again, or Catalyst would copy their expressions into each use
    return materialize(found, "mentions")


def with_other(found: DataFrame) -> DataFrame:
    """(doc_id, key, email, ip, card, phone, other): ``other`` are the candidates that touch no base span."""
    none = F.lit(-1).cast("bigint")
    base = F.concat(*(F.transform(k, lambda b: F.struct(b["start"].alias("start"), F.lit(0).alias("rank"), b["end"].alias("end"), F.lit(None).alias("c"))) for k in KINDS))
    every = F.array_sort(F.concat(base, F.transform("all", lambda c: F.struct(c["start"].alias("start"), F.lit(1).alias("rank"), c["end"].alias("end"), c.alias("c")))))

    def apart(rows: Column) -> Column:
        # in order of starts, a candidate touches a base span if one before it ends behind its start, or the next begins
        # before its end
        reach = running(F.transform(rows, lambda x: F.when(x["rank"] == 0, x["end"]).otherwise(none)), lambda a, b: F.greatest(a, b), none)
        far = F.lit(1 << 60).cast("bigint")
        ahead = F.reverse(running(F.reverse(F.transform(rows, lambda x: F.when(x["rank"] == 0, x["start"]).otherwise(far))), lambda a, b: F.least(a, b), far))
        met = F.arrays_zip(rows.alias("x"), reach.alias("reach"), ahead.alias("ahead"))
        free = F.filter(met, lambda m: (m["x"]["rank"] == 1) & (m["reach"] <= m["x"]["start"]) & (m["ahead"] >= m["x"]["end"]))
        return F.transform(free, lambda m: m["x"]["c"])

    return found.select("doc_id", "key", *KINDS, _bind(every, apart).alias("other"))


def _count_words(docs: DataFrame, wanted: DataFrame, broadcast_rows: int) -> DataFrame:
    """(word, total): occurrences of the wanted words in all texts."""
    words = docs.select(F.explode(F.split(lower_ascii(F.col("text").cast("string")), _BREAK + "+")).alias("word"))
    if wanted.count() <= broadcast_rows:
        wanted = F.broadcast(wanted)
    return words.join(wanted, "word").groupBy("word").agg(F.count("*").alias("total"))


def discover(
    docs: DataFrame, found: DataFrame, rounds: int = 3, support: int = 3, pattern_trust: float = 0.5, trust: float = 0.8, broadcast_rows: int = 1 << 20
) -> DataFrame:
    """(doc_id, key, kind, start, end): spans of instances that trusted patterns bring in.

    A pattern needs ``support`` distinct trusted instances and a confidence of ``pattern_trust`` to vouch for others.
    """
    seeds = [F.transform(k, _as_seed(k)) for k in KINDS]
    others = F.filter(F.transform("other", lambda m: F.struct(_shape(m["match"]).alias("kind"), F.lit(0.0).alias("seed"), m.alias("m"))), lambda x: x["kind"].isNotNull())
    all_ = materialize(
        found.select("doc_id", "key", F.explode(F.concat(*seeds, others)).alias("x")).select(
            "doc_id", "key", "x.kind", "x.seed", "x.m.start", "x.m.end", lower_ascii(F.col("x.m.match")).alias("instance"), "x.m.left", "x.m.right"
        ),
        "graph",
    )
    sides = F.array(F.struct(F.lit("L").alias("side"), F.col("left").alias("word")), F.struct(F.lit("R").alias("side"), F.col("right").alias("word")))
    edges = all_.select("kind", "instance", "seed", F.explode(sides).alias("p")).select("kind", "p.side", "p.word", "instance", "seed")
    edges = edges.groupBy("kind", "side", "word", "instance").agg(F.max("seed").alias("seed"), F.count("*").alias("n"))
    # signs alone, and the ends of a text, are no lexical pattern; whether instances are trusted is asked in each round,
    # as later rounds trust more of them.  Trust is 1 at most, so a pattern whose instances together do not reach
    # pattern_trust can never vouch.
    backed = edges.where(F.col("word").rlike(r"\p{L}")).groupBy("kind", "side", "word").agg(F.count("*").alias("instances"), F.sum("n").alias("most"))
    backed = materialize(backed.where(F.col("instances") >= support), "patterns")
    totals = _count_words(docs, backed.select("word").distinct(), broadcast_rows)
    backed = materialize(backed.join(totals, "word").where(F.col("most") / F.col("total") >= pattern_trust).select("kind", "side", "word", "total"), "backed")
    edges = materialize(edges.join(backed, ["kind", "side", "word"]), "edges")

    scored = edges.select("kind", "instance", "seed").groupBy("kind", "instance").agg(F.max("seed").alias("score"))
    for _ in range(rounds):
        trusted = edges.join(scored, ["kind", "instance"]).groupBy("kind", "side", "word").agg(
            F.sum(F.col("n") * F.col("score")).alias("held"), F.count_if(F.col("score") >= trust).alias("kinds"), F.max("total").alias("total"))
        trusted = trusted.where(F.col("kinds") >= support).select("kind", "side", "word", F.least(F.lit(0.999), F.col("held") / F.col("total")).alias("sure"))
        trusted = trusted.where(F.col("sure") >= pattern_trust)
        vouched = edges.join(trusted, ["kind", "side", "word"], "left").groupBy("kind", "instance")
        doubt = F.exp(F.sum(F.log(1 - F.coalesce("sure", F.lit(0.0)))))
        scored = materialize(vouched.agg(F.greatest(F.max("seed"), 1 - doubt).alias("score")), "scores")
    taken = scored.where(F.col("score") >= trust).select("kind", "instance")
    return all_.where("seed = 0").join(taken, ["kind", "instance"]).select("doc_id", "key", "kind", "start", "end")


_SPANS = "array<struct<rank:int,kind:string,start:bigint,end:bigint>>"


def _with_spans(found: DataFrame, docs: DataFrame, broadcast_spans: int = 1 << 19, **options) -> DataFrame:
    """``found`` with ``base`` and ``spans``.  Discovered spans are broadcast if there are ``broadcast_spans`` at most, so
    only beyond that are rows shuffled."""
    more = discover(docs, materialize(with_other(found), "base"), **options)
    rank = F.array_position(F.array(*(F.lit(k) for k in KINDS)), F.col("kind")).cast("int")
    more = more.groupBy("key").agg(F.collect_set(F.struct(rank.alias("rank"), "kind", F.col("start"), F.col("end"))).alias("more"))
    more = materialize(more, "more")
    few = (more.agg(F.sum(F.size("more"))).first()[0] or 0) <= broadcast_spans
    base = F.concat(*(F.transform(k, _as_span(i + 1, k)) for i, k in enumerate(KINDS)))
    joined = found.withColumn("base", base).join(F.broadcast(more) if few else more, "key", "left")
    return joined.withColumn("spans", F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))))


def find(docs: DataFrame, rounds: int = 3, support: int = 3, pattern_trust: float = 0.5, trust: float = 0.8) -> DataFrame:
    """(doc_id, key, base, spans) per row of ``docs`` (doc_id, text; other columns are ignored).

    ``base`` and ``spans`` are arrays of (rank, kind, start, end), ordered by kind as in KINDS and then start; spans
    are the base ones and those discovered.  Positions are code points, ends exclusive.  Null and empty texts have
    none; rows with a null or repeated doc_id are kept and hold the spans of their own text; an empty table gives no
    rows.
    """
    options = {"rounds": rounds, "support": support, "pattern_trust": pattern_trust, "trust": trust}
    return _with_spans(base_mentions(docs), docs, **options).select("doc_id", "key", "base", "spans")


def as_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redact(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind in angle brackets; all columns are kept.  Spans that
    overlap are replaced once, by the kind of the one that starts first."""
    found = _with_spans(base_mentions(docs, with_row=True), docs, **options)
    by_start = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), (-x["end"]).alias("order"), x["end"].alias("end"), x["kind"].alias("kind"))))
    text = F.col("row.text").cast("string")

    none = F.lit(0).cast("bigint")

    def mask(spans: Column) -> Column:
        reach = F.concat(F.array(none), running(F.transform(spans, lambda x: x["end"]), lambda a, b: F.greatest(a, b), none))
        return _bind(reach, lambda at: _bind(first_ones(spans, at), lambda rows: F.concat(before(rows), F.substring(text, (F.element_at(at, -1) + 1).cast("int"), F.char_length(text)))))

    def first_ones(spans: Column, reach: Column) -> Column:
        return F.filter(F.arrays_zip(spans.alias("x"), F.slice(reach, 1, F.size(spans)).alias("at")), lambda m: m["x"]["start"] >= m["at"])

    def before(rows: Column) -> Column:
        # a slice of a string is sought from its start, so some sqrt(n) spans share a slice of the text
        size = F.ceil(F.sqrt(F.size(rows))).cast("int")
        return F.array_join(F.transform(F.transform(F.sequence(F.lit(1), F.size(rows), size), lambda i: F.slice(rows, i, size)), replaced), "")

    def replaced(part: Column) -> Column:
        first, last = part[0]["at"], F.element_at(part, -1)["x"]["start"]
        shared = F.substring(text, (first + 1).cast("int"), (last - first).cast("int"))
        gap = lambda near, m: F.substring(near, (m["at"] - first + 1).cast("int"), (m["x"]["start"] - m["at"]).cast("int"))
        return _bind(shared, lambda near: F.array_join(F.transform(part, lambda m: F.concat(gap(near, m), F.lit("<"), m["x"]["kind"], F.lit(">"))), ""))

    masked = _bind(by_start, mask)
    columns = [F.when(F.size("spans") > 0, masked).otherwise(F.col("row.text")).alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in docs.columns]
    return found.select(*columns)
