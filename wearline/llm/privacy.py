"""Personal data: base patterns plus information-theoretic sanitisation, in DataFrame operations only.

Base spans are the leftmost non-overlapping matches of four patterns. The patterns run on the JVM with
possessive quantifiers and look-behinds that skip starts which cannot match, so a long run of like
characters costs linear time and no deep recursion; the matches are those of the plain patterns.

The method: every base match is a protected entity e, however seldom it occurs. What a term t leaves unknown of e is

    left(t, e) = -log2 P(e | t) bits,   P(e | t) = (k + m P(e)) / (k / r + m)

where r is the share of t's documents that hold it with e and k the number of different texts among these (copies are no
further evidence). "With e" is counted twice: within ``near`` characters of e (m = ``PRIOR``), and anywhere in the same text
(m = ``TEXT_PRIOR``: being in one text says less than being side by side). m draws a rate seen in few texts towards P(e).
A term gives e away if it leaves at most ``NEAR_BITS`` (``TEXT_BITS`` in the second count), and at most a tenth of e's own
-log2 P(e) bits, which only matters below some 6,000 documents. These are absolute amounts: they do not move with the size of the
corpus. What chance can mark is bounded: near an entity of one text only the words of its window, and elsewhere only words that
three different texts hold with it.

Every use in the corpus of a term that gives any entity away becomes a span of kind ``term``; if it leaves at most
``REMOVE_BITS`` (and 3 % of e's bits) it is removed from sanitised text, otherwise generalised.
Terms are words without digits; uses that overlap a base span are part of it.

Defined results: null texts are empty and have no spans; rows repeated with equal id and text get the same
spans; a null id is a value of its own; columns other than the id and the text are never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wearline.llm.common import WORD, stage

KINDS = ("email", "ip", "card", "phone", "term")
NEAR = 48
PRIOR, TEXT_PRIOR = 0.25, 2.0
#: bits that a term may leave unknown of an entity it gives away, by the two counts, and to be removed
NEAR_BITS, TEXT_BITS, REMOVE_BITS = 1.25, 0.8, 0.1
#: the same as shares of the entity's own bits
SHARE, REMOVE_SHARE = 0.1, 0.03
#: different texts that must hold a term with an entity before the second count can say anything
TEXTS = math.ceil(TEXT_PRIOR / (2**TEXT_BITS - 1))
#: rows and bytes that a join sends to every executor; larger tables are shuffled
SMALL, SMALL_BYTES = 1 << 18, 32 << 20
#: items that one step of a fold over a long array takes
BLOCK = 256
#: characters of a piece of a long text
PIECE = 4096

#: kind -> (pattern, a character or sequence without which it cannot match)
PATTERNS = {
    "email": (r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+", "."),
    "card": (r"(?=[0-9])(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
_SPANS = "array<struct<k:int,s:int,e:int,v:string>>"


def digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(v: Column) -> Column:
    """The card check sum of a string of digits, from its right end."""
    d = F.reverse(digits(v))

    def one(i):
        x = F.substring(d, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    places = F.sequence(F.lit(1), F.length(d))
    return F.aggregate(places, F.lit(0), lambda acc, i: acc + one(i)) % 10 == 0


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))).between(0, 3) & (F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)),
    "card": luhn,
    "phone": lambda v: F.length(digits(v)).between(8, 15),
}


def in_blocks(items: Column, carry: Column, empty: Column, step) -> Column:
    """A fold over an array that gives out things: ``step(carry, out, item) -> struct(carry, out)``. The items go in blocks, each with
    an ``out`` of its own, so that a long array costs its length times ``BLOCK`` at most, not its length squared. The outs of
    all blocks, in order."""
    start = F.struct(carry.alias("carry"), F.slice(F.array(empty), 1, 0).alias("outs"))

    def block(acc, some):
        done = F.aggregate(some, F.struct(acc["carry"].alias("carry"), empty.alias("out")), lambda a, x: step(a["carry"], a["out"], x))
        return once(done, lambda d: F.struct(d["carry"].alias("carry"), F.concat(acc["outs"], F.array(d["out"])).alias("outs")))

    def fold_(held):
        places = F.sequence(F.lit(0), F.greatest(F.floor((F.size(held) - 1) / BLOCK).cast("int"), F.lit(0)))
        return F.aggregate(F.transform(places, lambda i: F.slice(held, i * BLOCK + 1, F.lit(BLOCK))), start, block)

    return once(items, fold_)


def once(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: what stands twice in an expression is computed twice."""
    return F.transform(F.array(value), use)[0]


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` characters."""
    last = F.greatest(F.floor((F.length(text) - 1) / PIECE).cast("int"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * PIECE + 1, F.lit(PIECE)))


def cut(text: Column, pieces: Column, at: Column, length: Column) -> Column:
    """``length`` characters from ``at``: short ones from their pieces, since finding a place in a long text reads all of it."""
    j = F.floor(at / PIECE).cast("int")
    two = F.concat(F.coalesce(F.get(pieces, j), F.lit("")), F.coalesce(F.get(pieces, j + 1), F.lit("")))
    return F.when(length <= PIECE, F.substring(two, at - j * PIECE + 1, length)).otherwise(F.substring(text, at + 1, length))


def spans_of(text: Column, pattern: str, kind: int) -> Column:
    """All matches of a pattern with their places in code points: the text is split at the matches and the
    lengths of pieces and matches are summed up."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern) if isinstance(pattern, str) else pattern, F.lit(0)).alias("m"))

    def step(at, out, x):
        s = at + F.length(x["p"])
        e = s + F.length(x["m"])
        found = F.struct(F.lit(kind).alias("k"), s.alias("s"), e.alias("e"), x["m"].alias("v"))
        return F.struct(F.coalesce(e, s).alias("carry"), F.when(x["m"].isNull(), out).otherwise(F.concat(out, F.array(found))).alias("out"))

    return F.flatten(in_blocks(parts, F.lit(0), F.array().cast(_SPANS), step)["outs"])


def _valid(kind: str):
    return lambda x: VALID[kind](x["v"])


def _of_kind(k: int):
    return lambda x: x["k"] == k


def base_spans(text: Column) -> list[Column]:
    """One array of spans per kind; texts without a match cost one search."""
    out = []
    for k, (kind, (pattern, needs)) in enumerate(PATTERNS.items()):
        may = F.lit(True) if needs is None else F.contains(text, F.lit(needs))
        found = F.filter(spans_of(text, pattern, k), _valid(kind))
        out.append(F.when(may & text.rlike(pattern), found).otherwise(F.array().cast(_SPANS)))
    return out


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["s"].cast("string"), x["e"].cast("string"))), ",")


def entity(span: Column) -> Column:
    value = F.when(span["k"] == 0, F.lower(span["v"])).when(span["k"] == 1, span["v"]).otherwise(digits(span["v"]))
    return F.concat_ws(":", span["k"].cast("string"), value)


def find(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """``(doc_id, th, base, around, terms)``: base spans of each row, around each the text within ``near``
    characters on both sides, cut at the next base span's edge by the terms' own check later, and the terms of
    rows with base spans."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), "text", *[c.alias(f"b{i}") for i, c in enumerate(base_spans(F.col("text")))])
    rows = rows.withColumn("base", F.concat(*[F.col(f"b{i}") for i in range(len(PATTERNS))]))


    # spans in text order: those that may lie within ``near`` characters of one are its neighbours, a span being five at least
    lined = F.array_sort(F.transform("base", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k"), x["v"].alias("v"))))
    rows = rows.withColumn("lined", lined)

    def around(x, i, pieces):
        def side(at, length):
            return F.struct(at.alias("at"), cut(F.col("text"), pieces, at, length).alias("c"))

        left = F.greatest(x["s"] - near, F.lit(0))
        reach = near // 5 * 4 + 8  # four kinds may overlap one another
        close = F.slice("lined", F.greatest(i - reach, F.lit(0)) + 1, F.lit(2 * reach + 1))
        # one character more on each side shows whether the outermost word is whole
        return F.struct(entity(x).alias("entity"), side(F.greatest(left - 1, F.lit(0)), x["s"] - F.greatest(left - 1, F.lit(0))).alias("l"), side(x["e"], F.lit(near + 1)).alias("r"),
                        F.transform(close, lambda c: F.struct(c["s"].alias("s"), c["e"].alias("e"))).alias("close"))

    near_each = once(pieces_of(F.col("text")), lambda pieces: F.transform("lined", lambda x, i: around(x, i, pieces)))
    near_each = F.when(F.size("base") > 0, near_each).otherwise(F.transform(F.slice("lined", 1, 0), lambda x, i: around(x, i, F.array(F.lit("")))))
    return rows.select("doc_id", "th", "base", near_each.alias("around"), F.when(F.size("base") > 0, terms_of(F.col("text"))).alias("terms"))


def contexts(found: DataFrame, near: int = NEAR) -> DataFrame:
    """``(th, entity, term)``: whole words near an entity that hold no digit and overlap no base span; terms are
    the words with A-Z in lower case."""
    x = found.select("th", F.explode("around").alias("a"))
    x = x.select("th", "a.close", "a.entity", F.explode(F.array(
        F.struct(F.col("a.l.at").alias("at"), F.col("a.l.c").alias("c"), F.lit(True).alias("left")),
        F.struct(F.col("a.r.at").alias("at"), F.col("a.r.c").alias("c"), F.lit(False).alias("left")))).alias("z"))
    x = x.select("th", "close", "entity", "z.*").withColumn("w", F.explode(spans_of(F.col("c"), WORD, 4)))
    cut = F.when(F.col("left"), (F.col("w.s") == 0) & (F.col("at") > 0)).otherwise((F.col("w.e") == near + 1) & (F.length("c") == near + 1))
    s, e = (F.col("at") + F.col("w.s")), (F.col("at") + F.col("w.e"))
    x = x.where(~cut & ~F.col("w.v").rlike("[0-9]")).select("th", "close", "entity", fold(F.col("w.v")).alias("term"), s.alias("s"), e.alias("e"))
    clear = ~F.exists("close", lambda b: (b["s"] < F.col("e")) & (F.col("s") < b["e"]))
    return x.where(clear).select("th", "entity", "term")


def fold(c: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text: Column) -> Column:
    """The distinct words of a text that hold no digit."""
    return F.filter(F.array_distinct(F.split(fold(text), r"[\x20\x09-\x0D]+")), lambda t: (t != "") & ~t.rlike("[0-9]"))


def bits_left(k: Column, both: Column, uses: Column, p: Column, prior: float) -> Column:
    """What a term used in ``uses`` documents, ``both`` of them (``k`` different texts) with the entity, leaves unknown."""
    return -F.log2((k + prior * p) / (k * uses / both + prior))


def disclosures(words: DataFrame, holders: DataFrame, entities: DataFrame, near: int = NEAR) -> DataFrame:
    """``(entity, term, removed)`` of the pairs in which the term gives the entity away. ``words (term, uses)`` counts the
    documents of each term, ``holders`` are the distinct texts with base spans and their ``copies``."""
    tally = [F.count("*").alias("k"), F.sum("copies").alias("both")]
    copies = holders.select("th", "copies")
    side = contexts(holders, near).distinct().join(copies, "th").groupBy("entity", "term").agg(*tally).join(words, "term").join(entities, "entity")
    # the second count needs TEXTS texts of the entity and of the term, and not many more uses of the term than of the entity
    held = holders.select("th", F.explode(F.array_distinct("around.entity")).alias("entity")).join(entities.where(F.col("texts") >= TEXTS).select("entity", "most"), "entity")
    few = words.where((F.col("uses") >= TEXTS) & (F.col("uses") <= F.lit(entities.agg(F.max("most")).first()[0] or 0.0)))
    own = holders.select("th", "copies", F.explode("terms").alias("term")).join(few, "term")
    pairs = own.join(held, "th").where(F.col("most") >= F.col("uses"))
    whole = pairs.groupBy("entity", "term").agg(*tally, F.first("uses").alias("uses")).join(entities, "entity")

    def telling(df: DataFrame, prior: float, bits: float) -> DataFrame:
        own_bits = -F.log2("p")
        df = df.withColumn("left", bits_left(F.col("k"), F.col("both"), F.col("uses"), F.col("p"), prior))
        return df.where(F.col("left") <= F.least(F.lit(bits), SHARE * own_bits)).select(
            "entity", "term", (F.col("left") <= F.least(F.lit(REMOVE_BITS), REMOVE_SHARE * own_bits)).alias("removed"))

    return telling(side, PRIOR, NEAR_BITS).unionByName(telling(whole, TEXT_PRIOR, TEXT_BITS))


def uses_of(text: Column, marks: Column) -> Column:
    """Spans ``(s, e, removed)`` of all uses in a text of the terms of a map from terms to whether they are removed."""
    quoted = F.transform(F.map_keys(marks), lambda t: F.concat(F.lit(r"\Q"), F.replace(t, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E")))
    edge = r"[^\x20\x09-\x0D]"
    found = spans_of(text, F.concat(F.lit(f"(?i)(?<!{edge})(?:"), F.array_join(quoted, "|"), F.lit(f")(?!{edge})")), 4)
    return F.transform(found, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), F.element_at(marks, fold(x["v"])).alias("removed")))


def _small(df: DataFrame, text: str) -> DataFrame:
    """To every executor, if its rows and their bytes are few."""
    n, size = df.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text) + 64), F.lit(0))).first()
    return F.broadcast(df) if n <= SMALL and size <= SMALL_BYTES else df


def detect(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """One row per document: ``doc_id, th, base, added``; ``added`` holds the spans of revealing terms."""
    found = stage(find(docs, near), "found")
    total = found.count()
    copies = found.where(F.size("base") > 0).groupBy("th").agg(F.count("*").alias("copies"))
    holders = stage(found.where(F.size("base") > 0).select("th", "base", "around", "terms").dropDuplicates(["th"]).join(copies, "th"), "holders")
    entities = holders.select("copies", F.explode(F.array_distinct("around.entity")).alias("entity")).groupBy("entity").agg(F.sum("copies").alias("seen"), F.count("*").alias("texts"))
    p = F.col("seen") / F.lit(total + 1.0)
    # no term with more uses leaves as little as TEXT_BITS
    entities = stage(entities.select("entity", "texts", p.alias("p"), (F.col("seen") * 2**TEXT_BITS * (1 + TEXT_PRIOR * p) + 1e-6).alias("most")), "entities")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.xxhash64(text).alias("th"), text.alias("text"))
    words = stage(rows.select(F.explode(terms_of(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("uses")), "uses")
    telling = stage(disclosures(words, holders, entities, near).groupBy("term").agg(F.max("removed").alias("removed")), "telling")
    # every use in the corpus: first the texts of each telling term, then the places in them
    used = stage(rows.select("th", F.explode(terms_of(F.col("text"))).alias("term")).join(_small(telling, "term"), "term").groupBy("th", "term").agg(F.first("removed").alias("removed")), "used")
    marks = used.groupBy("th").agg(F.map_from_entries(F.collect_list(F.struct("term", "removed"))).alias("marks"))  # a text's own words
    n, size = used.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0))).first()
    marks = F.broadcast(marks) if n <= SMALL and size <= SMALL_BYTES else marks
    spans = rows.join(marks, "th").select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), uses_of(F.col("text"), F.col("marks")).alias("added")).dropDuplicates(["_id", "_th"])
    none = F.array().cast("array<struct<s:int,e:int,removed:boolean>>")
    clear = F.filter("added", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return found.join(spans, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("th") == F.col("_th")), "left").select(
        "doc_id", "th", "base", F.coalesce(clear, none).alias("added"))


def report(found: DataFrame) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans``."""
    counts = [F.size(F.filter("base", _of_kind(i))).cast("long").alias(f"n_{k}") for i, k in enumerate(PATTERNS)]
    added = F.transform("added", lambda x: F.struct(F.lit(4).alias("k"), x["s"].alias("s"), x["e"].alias("e"), F.lit("").alias("v")))
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", added)).alias("spans"))


def sanitised(text: Column, base: Column, added: Column) -> Column:
    """The text with base spans replaced by [KIND], telling terms removed or generalised to [TERM]; of
    overlapping spans the first (at equal starts the longest) counts."""
    marks = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    spans = F.concat(F.transform(base, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), F.element_at(marks, x["k"] + 1).alias("t"))),
                     F.transform(added, lambda x: F.struct(x["s"].alias("s"), (-x["e"]).alias("n"), F.when(x["removed"], "").otherwise("[TERM]").alias("t"))))

    def walk(pieces):
        def step(at, out, x):
            piece = F.concat(cut(text, pieces, at, x["s"] - at), x["t"])
            return F.when(x["s"] >= at, F.struct((-x["n"]).alias("carry"), F.concat(out, F.array(piece)).alias("out"))).otherwise(
                F.struct(F.greatest(at, -x["n"]).alias("carry"), out.alias("out")))

        return in_blocks(F.array_sort(spans), F.lit(0), F.array().cast("array<string>"), step)

    end = once(pieces_of(text), walk)
    whole = once(end, lambda d: F.concat(F.array_join(F.flatten(d["outs"]), ""), F.substring(text, d["carry"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data replaced in ``text`` and ``n_chars`` brought up to date; other columns, the
    order of columns and null texts stay."""
    got = detect(docs).where((F.size("base") > 0) | (F.size("added") > 0)).select(
        F.col("doc_id").alias("_id"), F.col("th").alias("_th"), F.col("base").alias("_base"), F.col("added").alias("_added")).dropDuplicates(["_id", "_th"])
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    both = docs.join(got, docs["doc_id"].eqNullSafe(F.col("_id")) & (key == F.col("_th")), "left")
    text = F.when(F.col("_base").isNull(), F.col("text")).otherwise(sanitised(F.col("text"), F.col("_base"), F.col("_added")))
    both = both.withColumn("text", text)
    if "n_chars" in docs.columns:
        both = both.withColumn("n_chars", F.when(F.col("_base").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return both.select(*docs.columns)
