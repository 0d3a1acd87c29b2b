"""Personal data and what gives it away; built-in functions only.

Base spans (e-mail and IP addresses, card and phone numbers) are protected entities. Words that share
documents with them are weighed by what they reveal: with document counts over the whole corpus, a
word's pointwise mutual information with an entity, as a share of the entity's information content,
tells how much of the entity the word discloses. Beyond thresholds the word is generalised or removed
wherever it stands, in documents without the entity too. On request only words near the entities are
weighed and marked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillwright.llm.common import settle, text_or_empty
from tillwright.llm.native_spans import spans, wanted_spans

# Possessive quantifiers and look-behinds change no match: what they skip could not match either.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[ -]?[0-9])++"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone")

#: Characters on either side of an entity in which words are weighed, if not in whole documents.
AROUND = 60
WORD = r"\p{L}{4,}+"
#: Words of whole documents.
LETTERS, BETWEEN = r"\p{L}++", r"\P{L}++"
#: The least and most numbers of 64 bits in which words that may disclose are looked up first; in between one for each.
SIEVE = 1 << 10, 1 << 21
#: Documents a word must share with an entity before it is judged.
MIN_SHARED = 3
#: Share of an entity's information that a word may disclose; and from which it is removed.
GENERALISE_FROM, REMOVE_FROM = 0.8, 0.95


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the check sum."""

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = digit * 2
        return total + F.when(i % 2 == 0, digit).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), step) % 10 == 0


def _small_parts(value: Column) -> Column:
    """Whether the four numbers are at most 255, however many zeros lead them."""
    return F.regexp_like(value, F.lit(r"^(?:0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]|)(?:\.(?=[0-9])|$)){4}$"))


def base_spans(text: Column) -> Column:
    """Base spans of a text without nulls: array of (start, kind number, end, value), in order."""
    digits_of = lambda s: F.length(_digits(s["value"]))
    by_kind = [
        spans(text, EMAIL, F.contains(text, F.lit("@"))),
        F.filter(spans(text, IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]"))), lambda s: _small_parts(s["value"])),
        F.filter(
            spans(text, CARD, F.regexp_like(text, F.lit("[0-9](?:[ -]?[0-9]){13}"))),
            lambda s: F.when(digits_of(s).between(14, 19), _luhn(_digits(s["value"]))).otherwise(False),
        ),
        F.filter(spans(text, PHONE, F.contains(text, F.lit("+"))), lambda s: digits_of(s).between(10, 15)),
    ]

    def numbered(number: int):
        return lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))

    return F.array_sort(F.concat(*(F.transform(s, numbered(n)) for n, s in enumerate(by_kind))))


def _entity(span: Column) -> Column:
    """What a span names, written alike wherever it occurs."""
    value = F.when(span["kind"] >= 2, _digits(span["value"])).otherwise(F.lower(span["value"]))
    return F.concat(span["kind"].cast("string"), F.lit(":"), value)


def _near(text: Column, base: Column, around: int) -> Column:
    """Words near base spans: array of (entity, term, start, end); words in other base spans are left out."""

    def words(span: Column, first: Column, last: Column) -> Column:
        begin = F.greatest(first - 1, F.lit(0))  # a character more on either side tells whether a word is cut there

        def whole(s: Column) -> Column:
            return (s["start"] + begin >= first) & (s["end"] + begin <= last)

        def placed(s: Column) -> Column:
            return F.struct(
                _entity(span).alias("entity"), F.lower(s["value"]).alias("term"), (s["start"] + begin).alias("start"), (s["end"] + begin).alias("end")
            )

        return F.transform(F.filter(spans(F.substring(text, begin + 1, last + 1 - begin), WORD), whole), placed)

    def beside(span: Column) -> Column:
        left, right = F.greatest(span["start"] - around, F.lit(0)), F.least(span["end"] + around, F.length(text))
        return F.concat(words(span, left, span["start"]), words(span, span["end"], right))

    def free(w: Column) -> Column:
        return ~F.exists(base, lambda s: _overlap(w, s))

    return F.filter(F.flatten(F.transform(base, beside)), free)


def _overlap(a: Column, b: Column) -> Column:
    return (a["start"] < b["end"]) & (a["end"] > b["start"])


def _gathered(docs: DataFrame, *more: str, around: int) -> DataFrame:
    """Columns row, base and near, and those named, written to the checkpoint folder."""
    texts = docs.select(*more, text_or_empty().alias("text_"))
    found = texts.select(*more, "text_", base_spans(F.col("text_")).alias("base"))
    near = F.when(F.size("base") > 0, _near(F.col("text_"), F.col("base"), around)).otherwise(F.array().cast("array<struct<entity:string,term:string,start:int,end:int>>"))
    return settle(found.select(*more, "base", near.alias("near")).withColumn("row", F.monotonically_increasing_id()))


def _share(counts: DataFrame) -> DataFrame:
    """Rows of counts (both, with_entity, with_term, total) that reach the thresholds, with their share."""
    information = F.log2(F.col("total") / F.col("with_entity"))
    mutual = F.log2(F.col("both") * F.col("total") / (F.col("with_entity") * F.col("with_term")))
    share = F.when(information > 0, mutual / information)
    return counts.where(F.col("both") >= MIN_SHARED).withColumn("share", share).where(F.col("share") >= GENERALISE_FROM)


def _kind(share: Column) -> Column:
    return F.when(share >= REMOVE_FROM, len(KINDS) + 1).otherwise(len(KINDS))


def disclosures(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    """Pairs of entity and term near it with the share of the entity's information that the term discloses.

    Counts are of documents and over the whole corpus. Only pairs that reach ``GENERALISE_FROM`` and
    ``MIN_SHARED`` are returned: columns entity, term, share.
    """
    pair = lambda w: F.struct(w["entity"].alias("entity"), w["term"].alias("term"))
    pairs = gathered.select(F.explode(F.array_distinct(F.transform("near", pair))).alias("p"))
    shared = pairs.groupBy("p.entity", "p.term").agg(F.count("*").alias("both")).where(F.col("both") >= MIN_SHARED)
    entities = gathered.select(F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    entities = entities.groupBy("entity").agg(F.count("*").alias("with_entity"))
    words = F.array_distinct(F.filter(F.split(F.lower(text_or_empty()), r"[^\p{L}]+"), lambda w: F.length(w) >= 4))
    terms = docs.select(F.explode(words).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    total = gathered.agg(F.count("*").alias("total"))
    counts = shared.join(entities, "entity").join(terms, "term").crossJoin(F.broadcast(total))  # one row
    return _share(counts).select("entity", "term", "share")


def _added_near(gathered: DataFrame, disclosing: DataFrame) -> DataFrame:
    """Per row with such words: row and added, an array of (start, kind number, end)."""
    words = gathered.where(F.size("near") > 0).select("row", F.explode("near").alias("w")).select("row", "w.*")
    spots = words.join(disclosing, ["entity", "term"]).groupBy("row", "start", "end").agg(_kind(F.max("share")).alias("kind"))
    return spots.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("added"))


def _words(text: Column) -> Column:
    """The distinct words of a text, of any length, in lower case."""
    return F.array_distinct(F.transform(F.filter(F.split(text, BETWEEN), lambda w: w != ""), F.lower))


def _keyed(docs: DataFrame) -> tuple[Column, Column]:
    """Text, and a digest of it and the id, if there is one: rows alike in both have the same spans."""
    doc_id = F.coalesce(F.col("doc_id").cast("string"), F.lit("")) if "doc_id" in docs.columns else F.lit("")
    text = text_or_empty()
    return text, F.unhex(F.md5(F.concat(doc_id, F.lit(" "), text).cast("binary")))


def _may_disclose(with_entity: Column, with_term: Column, total: Column) -> Column:
    """Whether a term could reach ``GENERALISE_FROM`` if all documents with the entity held it."""
    return F.log2(total / with_term) >= GENERALISE_FROM * F.log2(total / with_entity) - 1e-9


def disclosing_terms(docs: DataFrame, gathered: DataFrame) -> DataFrame:
    """Words of whole documents that disclose some entity, written to the checkpoint folder: columns term, kind.

    ``gathered`` has row, base and, of documents with entities, words. Entities of the very same
    documents (by a digest of 128 bits) disclose and are disclosed alike, so one of them stands for all;
    words too frequent for any entity of their document are left before they are paired.
    """
    held = gathered.where(F.size("base") > 0)
    found = held.select("row", F.explode(F.array_distinct(F.transform("base", _entity))).alias("entity"))
    rows = [F.bit_xor(F.xxhash64(F.lit(n), "row")).alias(f"rows_{n}") for n in (1, 2)]
    sets = found.groupBy("entity").agg(F.count("*").alias("with_entity"), *rows).where(F.col("with_entity") >= MIN_SHARED)
    members = found.join(sets, "entity").groupBy("row").agg(F.collect_set(F.struct("with_entity", "rows_1", "rows_2")).alias("sets"))
    members = settle(members.withColumn("most", F.array_max(F.col("sets.with_entity"))))
    terms = docs.select(F.explode(_words(text_or_empty())).alias("term")).groupBy("term").agg(F.count("*").alias("with_term"))
    counted = terms.where(F.col("with_term") >= MIN_SHARED).crossJoin(F.broadcast(gathered.agg(F.count("*").alias("total"))))  # one row
    words = held.select("row", "words").join(members.select("row", "most"), "row").select("row", "most", F.explode(F.split("words", " ")).alias("term"))
    words = words.join(counted, "term").where(_may_disclose(F.col("most"), F.col("with_term"), F.col("total"))).drop("most")
    near = F.filter("sets", lambda of: _may_disclose(of["with_entity"], F.col("with_term"), F.col("total")))
    pairs = words.join(members.select("row", "sets"), "row").select(F.explode(near).alias("of"), "term", "with_term", "total")
    shared = pairs.groupBy("of", "term", "with_term", "total").agg(F.count("*").alias("both"))
    return settle(_share(shared.select("term", "of.with_entity", "both", "with_term", "total")).groupBy("term").agg(_kind(F.max("share")).alias("kind")))


def _sieve(terms: DataFrame) -> DataFrame:
    """One row: numbers whose bits are set at the hashes of terms."""
    size = min(max(1 << terms.count().bit_length(), SIEVE[0]), SIEVE[1])
    hashed = terms.select(F.xxhash64("term").alias("h"))
    bits = hashed.groupBy(F.pmod("h", F.lit(size)).alias("id")).agg(F.bit_or(_bits(F.col("h"))).alias("bits"))
    filled = terms.sparkSession.range(size).join(bits, "id", "left").select(F.struct("id", F.coalesce("bits", F.lit(0)).alias("bits")).alias("b"))
    return filled.agg(F.transform(F.array_sort(F.collect_list("b")), lambda b: b["bits"]).alias("sieve"))


def _bits(hashed: Column) -> Column:
    """A number with the bits set that a hash stands for: three at most."""
    places = (F.shiftrightunsigned(hashed, by).cast("int").bitwiseAND(63) for by in (40, 46, 52))
    first, *others = (F.call_function("shiftleft", F.lit(1).cast("long"), at) for at in places)
    return first.bitwiseOR(others[0]).bitwiseOR(others[1])


def _passes(sieve: Column, term: Column) -> Column:
    """Whether a term may be one of the sieve; terms of the sieve always are."""

    def found(hashed: Column) -> Column:
        missing = F.bitwise_not(F.get(sieve, F.pmod(hashed, F.size(sieve)).cast("int")))
        return missing.bitwiseAND(_bits(hashed)) == 0

    return F.exists(F.array(F.xxhash64(term)), found)  # hashed once


def _added(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """Per document with such terms: key and added, an array of (start, kind number, end)."""
    text, key = _keyed(docs)
    texts = docs.select(key.alias("key"), text.alias("text_")).crossJoin(F.broadcast(_sieve(terms)))  # one row
    some = texts.where(F.exists(_words(F.col("text_")), lambda w: _passes(F.col("sieve"), w)))
    placed = wanted_spans(F.col("text_"), LETTERS, lambda value: _passes(F.col("sieve"), F.lower(value)))
    words = some.select("key", F.explode(placed).alias("w")).select("key", "w.start", "w.end", F.lower("w.value").alias("term"))
    spots = words.join(terms, "term").select("key", F.struct("start", "kind", "end").alias("spot"))
    return spots.groupBy("key").agg(F.collect_set("spot").alias("added"))  # rows alike give the same


ALL_KINDS = (*KINDS, "generalise", "remove")


def _with_spans(docs: DataFrame, *more: str, around: int | None) -> DataFrame:
    """Columns named, base and all_spans, both arrays of (start, kind number, end) in order."""
    if around is None:
        text, key = _keyed(docs)
        found = docs.select(*more, key.alias("key_"), text.alias("text_")).select(*more, "key_", "text_", base_spans(F.col("text_")).alias("base"))
        words = F.when(F.size("base") > 0, F.array_join(_words(F.col("text_")), " "))
        gathered = settle(found.select(*[F.col(c).alias(f"of_{c}") for c in more], F.col("key_").alias("key"), "base", words.alias("words")).withColumn("row", F.monotonically_increasing_id()))
        added = _added(docs, disclosing_terms(docs, gathered))
        found = gathered.drop("row", "words").join(added, "key", "left").withColumnsRenamed({f"of_{c}": c for c in more})
    else:
        gathered = _gathered(docs, *more, around=around)
        found = gathered.join(_added_near(gathered, disclosures(docs, gathered)), "row", "left")
    plain = F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    free = F.filter(F.coalesce("added", F.array().cast("array<struct<start:int,kind:int,end:int>>")), lambda w: ~F.exists("base", lambda s: _overlap(w, s)))
    return found.select(*more, plain.alias("base"), F.array_sort(F.concat(plain, free)).alias("all_spans"))


def _written(found: Column) -> Column:
    names = F.array(*map(F.lit, ALL_KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")


def personal_data(docs: DataFrame, around: int | None = AROUND) -> DataFrame:
    """Per document: doc_id, counts by kind, base_sha256 and spans.

    Null and empty texts have no spans. Rows repeat where documents do, and each copy counts as a
    document. Spans are kind:start:end in code points; besides the base kinds they are ``generalise``
    and ``remove`` for words that disclose an entity they stand near to, ``around`` characters away at
    most; if that is None, words of whole documents are weighed and marked in all documents.
    """
    found = _with_spans(docs, "doc_id", around=around)
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size("base") - F.size(F.array_remove(kinds, n))).cast("long").alias(f"n_{kind}") for n, kind in enumerate(KINDS)]
    digest = F.sha2(_written(F.col("base")).cast("binary"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, _written(F.col("all_spans")).alias("spans"))


def sanitise(docs: DataFrame, around: int | None = AROUND) -> DataFrame:
    """The documents with entities and generalised words named by kind and removed words gone.

    A span that begins inside an earlier one is part of it. Null texts stay null, empty ones empty; all
    other columns stay as they are, whatever their names. Repeated rows are repeated and each counts as a
    document; an empty table gives no rows. ``around`` is that of ``personal_data``.
    """
    whole_row = docs.select(F.struct("*").alias("doc"), "text", *(["doc_id"] if "doc_id" in docs.columns else []))  # whatever its columns are called
    found = _with_spans(whole_row, "doc", around=around)
    text = F.col("doc.text").cast("string")
    marks = F.array(*(F.lit(f"[{kind.upper()}]") for kind in KINDS), F.lit("[TERM]"), F.lit(""))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(seen: Column, s: Column) -> Column:
        kept = F.concat(seen["out"], F.substring(text, seen["at"] + 1, s["start"] - seen["at"]), marks[s["kind"]])
        inside = s["start"] < seen["at"]
        return F.struct(F.greatest(seen["at"], s["end"]).alias("at"), F.when(inside, seen["out"]).otherwise(kept).alias("out"))

    whole = F.aggregate("all_spans", start, step, lambda seen: F.concat(seen["out"], F.substring(text, seen["at"] + 1, F.length(text))))
    clean = F.when(text.isNull(), text).otherwise(whole)
    return found.select(*[clean.alias(c) if c.lower() == "text" else F.col("doc").getField(c).alias(c) for c in docs.columns])
