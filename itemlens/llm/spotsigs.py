"""Document fingerprints by spot signatures.

Text is lowered and reduced to words.  Every common word (an anchor) starts a chain: the
two content words that follow it, common words in between left out.  A text's
fingerprint is the set of hashes of its chains, sorted, in hexadecimal.  A text in which
no chain starts has its whole word sequence as its one chain; a text without words has
none.  Likeness is the Jaccard similarity of the sets (1 for two empty sets).

``similar_pairs`` joins fingerprints: equal ones are one class, classes are partitioned
by set length, and in a partition only sets of fitting length that share a signature of
their prefixes are compared.

All of it is DataFrame code.

Defined cases: a null text is empty; equal texts have equal fingerprints whatever their
ids; rows without an id count as the smallest ids; rows of one id follow each other by a
hash of the text; the only row's next document is itself; an empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from itemlens.llm.common import partitions

#: Common words of English, German, French and Spanish.
ANCHORS = (
    "a an and are as at be by for from in is it of on or that the this to was with "
    "das der die den dem ein eine einer ist mit nicht sich und von zu auf aus "
    "au avec dans des du est et la le les par pas pour que qui sur un une "
    "como con de del el en las los no para por se su y"
).split()
CHAIN = 2
#: Text bytes of one ordered bucket, on average.
BUCKET_BYTES = 16 << 20

#: Stands for an anchor where the words are joined again.
_MARK = "\x01"
_CHAIN = rf"{_MARK}(?=((?:{_MARK}*+ [^ {_MARK}]++){{{CHAIN}}}))"


def normal(text: Column) -> Column:
    """Lower-case words, a blank between them."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def with_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Add ``out``: the sorted distinct chain hashes of a text.

    Each step is a column of its own, so that none is evaluated twice.
    """
    words, chains, hashes = f"_{out}_words", f"_{out}_chains", f"_{out}_hashes"
    marked = F.transform(F.split(words, " "), lambda w: F.when(w.isin(ANCHORS), F.lit(_MARK)).otherwise(F.concat(F.lit(" "), w)))
    found = F.regexp_extract_all(F.array_join(marked, ""), F.lit(_CHAIN), F.lit(1))
    hashed = F.transform(F.array_distinct(found), lambda s: F.xxhash64(F.translate(s, _MARK, "")))
    whole = F.when(F.col(words) == "", F.array().cast("array<bigint>")).otherwise(F.array(F.xxhash64(words)))
    return (
        df.withColumn(words, normal(F.col(text)))
        .withColumn(chains, hashed)
        .withColumn(hashes, F.array_sort(F.array_distinct(chains)))
        .withColumn(out, F.when(F.size(hashes) > 0, F.col(hashes)).otherwise(whole))
        .drop(words, chains, hashes)
    )


def fingerprint(signatures: Column) -> Column:
    return F.concat_ws("", F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x), 16, "0"))))


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two signature sets."""
    same = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - same
    return F.when(union == 0, F.lit(1.0)).otherwise(same / union)


def length_band(n: Column, threshold: float) -> Column:
    """Sets whose likeness reaches the threshold are in one band or in neighbours."""
    return F.floor(F.log(F.greatest(n, F.lit(1))) / F.log(F.lit(1 / threshold))).cast("int")


def _bounds(docs: DataFrame, n: int) -> list[int]:
    """Up to ``n`` ids that occur, the greatest among them, cutting the rows evenly."""
    shares = [i / n for i in range(1, n)]
    cut = F.percentile_approx("order", shares, max(10_000, 20 * n)) if shares else F.array().cast("array<bigint>")
    row = docs.agg(cut.alias("cut"), F.max("order").alias("top")).first()
    return sorted({*(row.cut or []), row.top}) if row.top is not None else []


def _bucket(order: Column, bounds: list[int], width: int = 64) -> Column:
    """Number of bounds below a key, found among every 64th first and then near it."""
    coarse, fine = F.lit(bounds[::width]), F.lit(bounds)
    # The bounds before the block are all smaller; within it they are compared.
    block = F.greatest(F.size(F.filter(coarse, lambda b: b < order)) - 1, F.lit(0)) * width
    return (block + F.size(F.filter(F.slice(fine, block + 1, width), lambda b: b < order))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text and next_text, the text of the row that follows in descending order
    of doc_id; the first row follows the last.

    The rows are cut into ranges of ids; the greatest ids of each range are copied to
    the end of the range above, so that every row meets its follower in its own range.
    """
    rows = docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("order")
    )
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(partitions(docs.sparkSession), -(-size // BUCKET_BYTES))
    bounds = _bounds(rows, n)
    if not bounds:
        bounds = [0]
    rows = rows.withColumn("bucket", _bucket(F.col("order"), bounds))
    copy = F.when(F.col("order").isin(bounds), F.pmod(F.col("bucket") + 1, F.lit(len(bounds))))
    places = F.array_compact(F.array(F.struct(F.col("bucket").alias("at"), F.lit(0).alias("copied")), F.when(copy.isNotNull(), F.struct(copy.alias("at"), F.lit(1).alias("copied")))))
    rows = rows.withColumn("place", F.explode(places)).select("doc_id", "text", "order", "place.at", "place.copied")
    following = W.partitionBy("at").orderBy("copied", F.desc("order"), F.xxhash64("text"))
    return (
        rows.withColumn("next_text", F.lead("text").over(following)).where("copied = 0").select("doc_id", "text", "next_text")
    )


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints, near_edited and near_next."""
    rows = with_next(docs)
    n = F.length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - half), F.substring("next_text", F.lit(1), half))
    rows = rows.withColumn("edited", edited)
    for name, text in (("own", "text"), ("edited_own", "edited"), ("next_own", "next_text")):
        rows = with_signatures(rows, text, name)
    return rows.select(
        "doc_id",
        n.cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        fingerprint(F.col("own")).alias("fingerprint"),
        fingerprint(F.col("edited_own")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("edited_own")).alias("near_edited"),
        likeness(F.col("own"), F.col("next_own")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(classes, links): doc_id with the class of its fingerprint, and pairs of classes
    (a, b, likeness) whose likeness reaches the threshold.

    A class is named by its fingerprint's hash.  Signatures are ordered by how few
    classes have them, so that prefixes hold the rare ones and common ones aren't joined.
    """
    own = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "own").drop("text")
    own = own.withColumn("class", F.xxhash64(F.concat_ws(",", F.col("own").cast("array<string>"))))
    sets = own.where(F.size("own") > 0).groupBy("class").agg(F.min("own").alias("own"))
    sets = sets.withColumn("n", F.size("own"))
    sigs = sets.select("class", "n", F.explode("own").alias("sig"))
    often = sigs.groupBy("sig").agg(F.count("*").alias("often"))
    ranked = sigs.join(often, "sig").groupBy("class", "n").agg(F.array_sort(F.collect_list(F.struct("often", "sig"))).alias("sorted"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1
    prefix = ranked.select("class", "n", F.explode(F.slice("sorted", F.lit(1), keep.cast("int"))).alias("s"))
    prefix = prefix.where("s.often > 1").select("class", "n", "s.sig", length_band(F.col("n"), threshold).alias("band"))
    # A set looks for partners of its own length or shorter, in its band and the one below
    # (and one more, as logarithms are rounded).
    seek = prefix.withColumn("band", F.explode(F.array("band", F.col("band") - 1, F.col("band") - 2)))
    met = seek.alias("x").join(prefix.alias("y"), ["band", "sig"])
    met = met.where((F.col("y.n") >= F.col("x.n") * threshold - 1e-9) & (F.struct("y.n", "y.class") < F.struct("x.n", "x.class")))
    pairs = met.select(F.col("x.class").alias("a"), F.col("y.class").alias("b")).distinct()
    both = pairs.join(sets.select(F.col("class").alias("a"), F.col("own").alias("p")), "a").join(sets.select(F.col("class").alias("b"), F.col("own").alias("q")), "b")
    links = both.select("a", "b", likeness(F.col("p"), F.col("q")).alias("likeness")).where(F.col("likeness") >= threshold - 1e-9)
    return own.select("doc_id", "class"), links
