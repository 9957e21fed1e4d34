"""Secret scanning through a trigram inverted index.  DataFrame functions only.

Each rule's regex is parsed into a Boolean query over lower-cased trigrams, an OR of ANDs
(``regex_trigrams``).  Rows are dealt into numbered slots, eight or more a row as long as the bound
on slots allows.  The index holds, for each trigram that some query asks for, its postings: the
slots whose texts have it, as bitmaps over pages of slots.  A query ANDs the bitmaps of its trigrams
and ORs those of its alternatives.  What comes out, a bitmap a rule of bounded size, is broadcast;
rows in its slots are the candidates, and the rule's own regex verifies them on the whole text.  So
rows that share a slot only add rows to verify, and no text is ever exchanged.  Rules without a
mandatory trigram scan every text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, staged
from .regex_trigrams import ANY, Query, derive


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``group`` of the match has at least ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


# The base rules' patterns and lengths.
BASE = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]+", 0, 32),
)
#: What this operator finds besides.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,255}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE
#: Slots: at least so many, and at most (2**25 make 4 MB a rule to broadcast, whatever the corpus is).
LEAST_SLOTS, MOST_SLOTS = 1 << 15, 1 << 25
#: Slots of a page, as the bitmap functions have it.
PAGE = 1 << 15
#: Matches whose offsets are summed in one go; the sums of such blocks are summed after that.
BLOCK = 256
#: Runs of one character class: only their least length can go into the pattern with the same matches.
_CLASS_RUN = re.compile(r"^(\[\^?[^\[\]\\^]+\])\+$")
_SPANS = "array<struct<start:int,rule:int,end:int>>"


def queries_of(rules: tuple[Rule, ...]) -> dict[int, Query]:
    """The queries by rule number; rules without a mandatory trigram have none."""
    found = {i: derive(r.pattern) for i, r in enumerate(rules)}
    return {i: q for i, q in found.items() if q != ANY}


def slots_for(rows: int, most: int = MOST_SLOTS) -> int:
    return min(most, max(LEAST_SLOTS, 1 << (8 * rows).bit_length()))


def slot(identity: Column, text: Column, slots: int) -> Column:
    """Any function of the row will do: rows of one slot are candidates together."""
    return F.pmod(F.xxhash64(identity.cast("string"), F.octet_length(text)), F.lit(slots))


def build_index(docs: DataFrame, slot: Column, text: Column, wanted: list[str]) -> DataFrame:
    """Postings (trigram number, page, slots as a bitmap) of the ``wanted`` trigrams.

    Long lists lie in pages, so a trigram that is in every text is spread as far as a rare one.
    """
    lowered = docs.select(slot.alias("slot"), F.lower(text).alias("text"))
    held = F.array_compact(F.array(*[F.when(F.contains("text", F.lit(t)), F.lit(i)) for i, t in enumerate(wanted)]))
    pairs = lowered.select("slot", F.explode(held).alias("trigram"))
    paged = pairs.select("trigram", F.floor(F.col("slot") / PAGE).cast("int").alias("page"), (F.col("slot") % PAGE).alias("at"))
    return paged.repartition("trigram", "page").groupBy("trigram", "page").agg(F.bitmap_construct_agg("at").alias("slots"))


def intersect(index: DataFrame, wanted: list[str], queries: dict[int, Query]) -> DataFrame:
    """(page, rules): by page a map from rule number to the bitmap of slots on which its query holds."""
    spark = index.sparkSession
    number = {t: i for i, t in enumerate(wanted)}
    asked = [(rule, at, number[t], len(every)) for rule, q in queries.items() for at, every in enumerate(sorted(map(sorted, q))) for t in every]
    # bounded by the rules; what is joined are bitmaps
    terms = spark.createDataFrame(asked, "rule int, alternative int, trigram int, size int")
    met = index.join(F.broadcast(terms), "trigram").groupBy("page", "rule", "alternative").agg(F.bitmap_and_agg("slots").alias("slots"), F.count(F.lit(1)).alias("n"), F.max("size").alias("size"))
    ruled = met.where("n = size").groupBy("page", "rule").agg(F.bitmap_or_agg("slots").alias("slots"))
    return ruled.groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("rule", "slots"))).alias("rules"))


def _held(bitmap: Column, at: Column) -> Column:
    """Whether bit ``at`` of the bitmap is set; null where there is no bitmap."""
    byte = F.conv(F.hex(F.substring(bitmap, (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.expr("shiftleft(1, int(_gm_at % 8))")) != 0


def _matches(text: Column, number: int, rule: Rule) -> Column:
    """Spans of the rule's matches: what lies between matches gives the offsets.

    The offsets are running sums over blocks of matches, then over blocks: a match costs a step and
    the copy of at most a block, however many there are.
    """
    sizes = F.zip_with(
        F.split(text, rule.pattern, -1),
        F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0)),
        lambda gap, match: F.struct(
            F.length(gap).alias("gap"),
            F.coalesce(F.length(match), F.lit(0)).alias("size"),
            F.coalesce(F.length(F.regexp_extract(match, rule.pattern, rule.group)) if rule.group else F.length(match), F.lit(0)).alias("kept"),
        ),
    )
    none = F.array().cast(_SPANS)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + x["gap"]
        end = begin + x["size"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("rule"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(x["kept"] >= rule.least, F.concat(state["out"], F.array(span))).otherwise(state["out"]).alias("out"))

    def block(every: Column, i: Column) -> Column:
        return F.aggregate(F.slice(every, i * BLOCK + 1, F.lit(BLOCK)), F.struct(F.lit(0).alias("at"), none.alias("out")), step)

    def blocks(every: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), ((F.size(every) - 1) / BLOCK).cast("int")), lambda i: block(every, i))

    def moved(state: Column, x: Column) -> Column:
        return F.struct((state["at"] + x["at"]).alias("at"), F.concat(state["from"], F.array(state["at"])).alias("from"))

    def placed(found: Column) -> Column:
        begins = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("from")), moved)["from"]
        return F.flatten(
            F.zip_with(
                found,
                begins,
                lambda x, low: F.transform(x["out"], lambda s: F.struct((s["start"] + low).alias("start"), s["rule"].alias("rule"), (s["end"] + low).alias("end"))),
            )
        )

    # a one-element array binds a value that is used more than once
    found = F.element_at(F.transform(F.array(sizes), blocks), 1)
    return F.element_at(F.transform(F.array(found), placed), 1)


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: tuple[Rule, ...] = RULES, most_slots: int = MOST_SLOTS) -> DataFrame:
    """One row per input row: id and spans, array<struct<start, rule, end>> in code points.

    ``rule`` is the position in ``rules``; spans are ordered by start, then rule.  Matches are
    leftmost and do not overlap within a rule; matches whose group is too short are dropped after
    that.  Null and empty texts have no spans; null ids are kept.  Repeated rows come out alike.  A
    long text is read as a whole.  An empty table gives no rows.  Columns other than id and text are
    not read, whatever they are called.

    Beyond ``most_slots`` / 8 rows slots fill up and more rows are verified that a query would have
    spared; results are the same.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"))
    queries = queries_of(rules)
    wanted = sorted({t for q in queries.values() for every in q for t in every})
    slots = slots_for(own.count(), most_slots)
    number = slot(F.col("id"), F.col("text"), slots)
    index = staged(build_index(own, number, F.col("text"), wanted), "trigrams")
    # a page is PAGE / 8 bytes a rule, and there are at most most_slots / PAGE pages
    met = staged(intersect(index, wanted, queries), "candidates")
    discard(index)
    marked = own.withColumn("_gm_slot", number).withColumn("page", F.floor(F.col("_gm_slot") / PAGE).cast("int")).withColumn("_gm_at", F.col("_gm_slot") % PAGE)
    joined = marked.join(F.broadcast(met), "page", "left")
    parts = []
    for i, rule in enumerate(rules):
        text = F.col("text")
        # a cheap look first: most texts that are scanned have nothing
        narrow = Rule(rule.kind, rule.pattern if rule.group else _CLASS_RUN.sub(rf"\1{{{rule.least},}}", rule.pattern), rule.group, rule.least)
        worth = text.rlike(narrow.pattern)
        if i in queries:
            worth = F.coalesce(_held(F.col("rules")[i], F.col("_gm_at")), F.lit(False)) & worth
        parts.append(F.when(worth, _matches(text, i, narrow)).otherwise(F.array().cast(_SPANS)))
    return joined.select(F.col("id").alias(id_column), F.array_sort(F.concat(*parts)).alias("spans"))


def written(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["rule"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
