"""Canonical exact fingerprints of documents, in DataFrame functions only.

A text's canonical form is Unicode-composed (compatibility forms unified),
case-folded and has each run of white space folded to one space. Its
fingerprint is two independently seeded 64-bit XXH64 hashes. Texts of equal
hashes are then grouped by the bytes of their canonical form, so a collision
shows; colliding texts carry a SHA-256 in their fingerprint on top.

Nulls count as empty text. Repeated rows are separate documents. The ICU calls
are methods of the ICU library that Spark itself ships.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from motifloom.session import scratch, store

_NORMALIZER, _CHARACTER = "com.ibm.icu.text.Normalizer", "com.ibm.icu.lang.UCharacter"

#: Ids a bucket of neighbours spans, and ids of buckets a window of those spans, in bits.
NEAR_BITS, FAR_BITS = 8, 18


def compose(text: Column, compatible: bool = True) -> Column:
    """Unicode NFKC, or NFC if not ``compatible``."""
    return F.reflect(F.lit(_NORMALIZER), F.lit("compose"), text, F.lit(compatible))


def canonical(text: Column, compatible: bool = True) -> Column:
    """The canonical form; folding can undo composition, so that is done again."""
    folded = F.reflect(F.lit(_CHARACTER), F.lit("foldCase"), compose(F.coalesce(text, F.lit("")), compatible), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded, compatible), r"[\s\p{Z}\x1C-\x1F\x85]+", " "))


def wide_hash(canon: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), canon), F.xxhash64(F.lit(2), canon)]


def with_hash(df: DataFrame, text: str, prefix: str = "") -> DataFrame:
    """Add ``h1``, ``h2`` and the tie-breaker ``tie`` of the canonical form of column ``text``."""
    names = ["h1", "h2", "tie"]
    df = df.withColumn("_canon", canonical(F.col(text)))
    cols = [*wide_hash(F.col("_canon")), F.unhex(F.sha2("_canon", 256))]
    return df.withColumns({prefix + n: c for n, c in zip(names, cols, strict=True)}).drop("_canon")


def _by_bytes(rows: DataFrame) -> DataFrame:
    """``(h1, h2, tie, first_id, copies, mixed)`` of ``rows(_id, h1, h2, canon)``, buckets split by their bytes."""
    forms = rows.groupBy("h1", "h2", "canon").agg(F.min("_id").alias("first_id"), F.count("*").alias("copies"))
    forms = forms.select("h1", "h2", F.unhex(F.sha2("canon", 256)).alias("tie"), "first_id", "copies")
    part = F.struct("tie", "first_id", "copies")
    buckets = forms.groupBy("h1", "h2").agg(F.collect_list(part).alias("forms"))  # one form but for collisions
    return buckets.select("h1", "h2", F.explode("forms").alias("f"), (F.size("forms") > 1).alias("mixed")).select("h1", "h2", "f.*", "mixed")


def digest_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(h1, h2, tie, first_id, copies, mixed)`` for each different canonical form.

    Hash buckets are split by the bytes themselves; ``mixed`` tells that a
    bucket holds more than one form. Counts are combined before the shuffle,
    so a form with very many copies is one row from each task.
    """
    rows = docs.select(F.col(id_col).alias("_id"), canonical(F.col(text_col).cast("string")).alias("canon"))
    h1, h2 = wide_hash(F.col("canon"))
    return _by_bytes(rows.select("_id", h1.alias("h1"), h2.alias("h2"), "canon"))


def shown(h1: Column, h2: Column, tie: Column, mixed: Column) -> Column:
    """A fingerprint as hex digits."""
    wide = F.concat(*[F.lower(F.lpad(F.hex(h), 16, "0")) for h in (h1, h2)])
    return F.when(mixed, F.concat(wide, F.lower(F.hex(tie)))).otherwise(wide)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``fingerprint``, ``group_id`` (smallest id of an equal form) and ``group_size``.

    Columns of ``docs`` by these names give way; all others are kept.
    """
    added = ("fingerprint", "group_id", "group_size")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in added])
    marked = with_hash(docs.select(row.alias("_row"), F.col(text_col).cast("string").alias("_text")), "_text").drop("_text")
    out = marked.join(digest_groups(docs, id_col, text_col), ["h1", "h2", "tie"], "left")
    return out.select(
        "_row.*",
        shown(F.col("h1"), F.col("h2"), F.col("tie"), F.col("mixed")).alias("fingerprint"),
        F.col("first_id").alias("group_id"),
        F.col("copies").alias("group_size"),
    )


def following(values: DataFrame, levels: int = 2) -> DataFrame:
    """``(x, nx)``: for each of the distinct longs ``x`` the next larger one, null for the last.

    Values are ordered within groups of their high bits, and groups likewise,
    so that no window sees more than ``2 ** FAR_BITS`` rows below the top.
    """
    if not levels:
        top = Window.partitionBy(F.lit(0)).orderBy("x")
        return values.select("x", F.lead("x").over(top).alias("nx"))
    mine = Window.partitionBy("g").orderBy("x")
    inner = values.withColumn("g", F.shiftright("x", FAR_BITS)).select("x", "g", F.lead("x").over(mine).alias("own"))
    heads = values.groupBy(F.shiftright("x", FAR_BITS).alias("g")).agg(F.min("x").alias("head"))
    up = following(heads.select(F.col("g").alias("x")), levels - 1).select(F.col("x").alias("g"), F.col("nx").alias("ng"))
    ahead = up.join(heads.select(F.col("g").alias("ng"), "head"), "ng").select("g", "head")
    return inner.join(ahead, "g", "left").select("x", F.coalesce("own", "head").alias("nx"))


def in_buckets(docs: DataFrame) -> DataFrame:
    """``docs`` that have an id, with the small bucket of neighbouring ids each is in."""
    return docs.where("doc_id is not null").withColumn("bucket", F.shiftright("doc_id", NEAR_BITS))


#: Bits of the sketch that picks texts out; it is sent as rows of 4 KB, 8 MB at most.
SKETCH_BITS = 1 << 26


def picked(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` whose ``doc_id`` is in ``ids``, and a few others: nothing is shuffled but a sketch of fixed size."""
    spot = F.pmod(F.xxhash64("doc_id"), F.lit(SKETCH_BITS))
    bucket, position = F.expr("spot div 32768").alias("sketch"), F.expr("spot % 32768")
    bits = ids.select(spot.alias("spot")).groupBy(bucket).agg(F.bitmap_construct_agg(position).alias("bits"))
    byte = F.conv(F.hex(F.expr("substring(bits, cast(spot % 32768 div 8 + 1 as int), 1)")), 16, 10).cast("int")
    marked = docs.withColumn("spot", spot).withColumn("sketch", F.expr("spot div 32768")).join(F.broadcast(bits), "sketch")
    return marked.where(F.getbit(byte, F.expr("cast(spot % 8 as int)")) == 1).select(*docs.columns)


def groups_with_sketch(docs: DataFrame) -> DataFrame:
    """``digest_groups`` of ``docs(doc_id, text, h1, h2, tie)``, with few texts moved.

    A hash that one document has is a group as it is. The documents of other
    hashes are picked out by a sketch of their ids, and only their bytes are
    shuffled.
    """
    marks = store(docs.select("doc_id", "h1", "h2", "tie"), "marks").read()
    counts = marks.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.first("tie").alias("tie"), F.min("doc_id").alias("first_id"))
    counts = store(counts, "mark-counts").read()
    once = counts.where("n = 1").select("h1", "h2", "tie", "first_id", F.col("n").alias("copies"), F.lit(False).alias("mixed"))
    again = counts.where("n > 1").select("h1", "h2")
    ids = marks.where("doc_id is not null").join(again, ["h1", "h2"], "left_semi").select("doc_id")
    some = picked(docs.where("doc_id is not null"), ids).union(docs.where("doc_id is null"))
    rows = some.select(F.col("doc_id").alias("_id"), "h1", "h2", canonical(F.col("text")).alias("canon")).join(again, ["h1", "h2"], "left_semi")
    return once.union(_by_bytes(rows))


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text, h1, h2)`` with the next document's ``next_text``, ``next_h1``, ``next_h2``.

    Next is by ``(doc_id, text)``; after the last comes the first. Documents
    without an id have no next: nulls. Neighbours meet in small buckets of ids
    by one shuffle of the texts; a bucket's last document gets the first of the
    next bucket that holds any by a join of those few.
    """
    cols = ["text", "h1", "h2"]
    bucket = F.shiftright("doc_id", NEAR_BITS)
    known = in_buckets(docs)
    order = Window.partitionBy("bucket").orderBy("doc_id", "text")
    inside = known.withColumns({f"own_{c}": F.lead(c).over(order) for c in cols})
    heads = known.groupBy("bucket").agg(F.min(F.struct("doc_id", *cols)).alias("head"))
    steps = following(docs.where("doc_id is not null").select(bucket.alias("x")).distinct())
    least = docs.where("doc_id is not null").agg(F.shiftright(F.min("doc_id"), NEAR_BITS).alias("least"))
    steps = steps.crossJoin(F.broadcast(least)).select(F.col("x").alias("bucket"), F.coalesce("nx", "least").alias("nb"))
    ahead = steps.join(heads.withColumnRenamed("bucket", "nb"), "nb").select("bucket", "head")
    joined = inside.join(ahead, "bucket", "left")
    nexts = [F.coalesce(f"own_{c}", f"head.{c}").alias(f"next_{c}") for c in cols]
    lone = docs.where("doc_id is null").select("*", *[F.lit(None).cast(dict(docs.dtypes)[c]).alias(f"next_{c}") for c in cols])
    return joined.select(*docs.columns, *nexts).unionByName(lone)


def edit_study(docs: DataFrame) -> DataFrame:
    """How the fingerprint of ``docs(doc_id, text)`` stands to edits and neighbours.

    The edited text has its last ``floor(n / 2)`` code points replaced by the
    first as many of the next document. Likeness is 1 for canonical forms of
    equal bytes, else 0: an exact digest knows no nearness.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    hashed = with_hash(rows, "text")
    pairs = with_next(hashed)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, length(text) - cast(floor(length(text) / 2) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    pairs = with_hash(pairs.withColumn("n_chars", n.cast("long")).withColumn("edited", edited), "edited", "e_")

    def same(a: str, b: str, other: str) -> Column:
        equal_bytes = canonical(F.col("text")) == canonical(F.col(other))
        hashes = (F.col("h1") == F.col(f"{a}h1")) & (F.col("h2") == F.col(f"{b}h2"))
        return F.when(hashes, F.when(equal_bytes, 1.0).otherwise(0.0)).otherwise(0.0)

    slim = pairs.select(
        "doc_id", "n_chars", "h1", "h2", "tie", "e_h1", "e_h2", "e_tie",
        F.sha2("edited", 256).alias("edited_sha256"),
        same("e_", "e_", "edited").alias("near_edited"),
        F.when(F.col("next_h1").isNotNull(), same("next_", "next_", "next_text")).otherwise(0.0).alias("near_next"),
    )
    with scratch(docs.sparkSession):
        groups = store(groups_with_sketch(hashed), "digest-groups").keep()
    groups = groups.read()
    mixed = groups.where("mixed").select(F.col("h1").alias("e_h1"), F.col("h2").alias("e_h2"), F.lit(True).alias("e_mixed")).distinct()
    out = slim.join(groups, ["h1", "h2", "tie"], "left").join(mixed, ["e_h1", "e_h2"], "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return out.select(
        "doc_id", "n_chars", "edited_sha256",
        shown(F.col("h1"), F.col("h2"), F.col("tie"), yes("mixed")).alias("fingerprint"),
        shown(F.col("e_h1"), F.col("e_h2"), F.col("e_tie"), yes("e_mixed")).alias("edited_fingerprint"),
        "near_edited", "near_next",
        F.col("first_id").alias("group_id"), F.col("copies").alias("group_size"),
    )
