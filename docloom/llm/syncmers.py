"""Document fingerprints from closed syncmers, in DataFrame expressions only.

A text is cut into units: runs of letters, marks and digits, and every other
visible character on its own, also each character of scripts written without
spaces.  A k-mer of units is a closed syncmer if the smallest of its inner
s-mers, by hash, stands at its first or last place.  Whether it is one
depends on its own units alone, so an edit changes syncmers only where it
touches, and the same passage has the same anchors wherever it stands.

A fingerprint has all anchors with their positions, so it grows with the
text.  Two texts are compared by all anchors of both: an anchor matches one of
the other text with the same hash that has the same next anchor at the same
distance, each at most once.  So a passage still matches where it has moved as
a whole, and equal anchors in other surroundings don't.

Defined cases: a null text is empty; a text without units has no anchor and
the empty fingerprint; a text with fewer units than a k-mer has its whole
sequence as one anchor; two empty fingerprints are alike (1), an empty and
another one are not (0); rows with equal ids are ordered by their texts' hash;
null ids come last; an empty table gives no rows; further columns are not
read.  A text is held whole, with about 50 times its size of anchors, links and
fingerprint.  Rows that share one id, or none, are neighbours in one bucket,
which is sorted with spilling and not held.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .runtime import materialize, partitions

K = 5
S = 2

#: Scripts written without spaces between words.
_UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
UNITS = rf"[\p{{L}}\p{{M}}\p{{N}}&&[^{_UNSPACED}]]+|\S"


def _bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, as a lambda's argument."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def anchors(text: Column, k: int = K, s: int = S) -> Column:
    """Array of (position, hash) of a text's closed syncmers, in text order."""
    units = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(UNITS), F.lit(0))
    hashed = F.transform(units, lambda u: F.xxhash64(u))

    def inner(h: Column) -> Column:
        # The s-mer that starts at each unit.
        return F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, s)]))

    def pick(m: Column, h: Column) -> Column:
        width = k - s + 1

        def chosen(x: Column, i: Column) -> Column:
            last = F.get(m, i + (width - 1))
            middle = [F.get(m, i + j) for j in range(1, width - 1)]
            edge = F.least(x, last) <= F.least(*middle) if len(middle) > 1 else F.least(x, last) <= middle[0]
            return F.when(
                (i + k <= F.size(h)) & edge,
                F.struct(i.alias("position"), F.xxhash64(*[F.get(h, i + j) for j in range(k)]).alias("hash")),
            )

        found = F.filter(F.transform(m, chosen), lambda a: a.isNotNull())
        whole = F.array(F.struct(F.lit(0).alias("position"), F.xxhash64(F.array_join(F.transform(h, lambda x: x.cast("string")), " ")).alias("hash")))
        short = (F.size(h) > 0) & (F.size(h) < k)
        return F.when(short, whole).otherwise(found)

    return _bind(hashed, lambda h: _bind(inner(h), lambda m: pick(m, h)))


def links(found: Column) -> Column:
    """Each anchor with the distance to its next one and that one's hash, as a hash."""

    def link(x: Column, i: Column) -> Column:
        following = F.get(found, i + 1)  # null after the last one, which a hash skips
        return F.xxhash64(x["hash"], following["position"] - x["position"], following["hash"])

    return F.transform(found, link)


def render(found: Column) -> Column:
    """Anchors as a string: for each the distance from the one before (the first: its position), a dot, its hash in 16 hexadecimal digits."""

    def one(x: Column, i: Column) -> Column:
        before = F.when(i > 0, F.get(found, i - 1)["position"]).otherwise(F.lit(0))
        return F.concat((x["position"] - before).cast("string"), F.lit("."), F.lpad(F.lower(F.hex(x["hash"])), 16, "0"))

    return F.array_join(F.transform(found, one), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two texts' anchors, matched by their links, repeats counted."""
    # The lowest bit says whose a link is; sorted, equal links stand together, those of a first.
    tagged = lambda links_, bit: F.transform(links_, lambda x: x.bitwiseAND(F.lit(-2)).bitwiseOR(F.lit(bit)))
    both = F.sort_array(F.concat(tagged(a, 0), tagged(b, 1)))
    # ``open``: links of a equal to the present one that no link of b has matched yet.
    start = F.struct(F.lit(0).cast("long").alias("link"), F.lit(0).alias("open"), F.lit(0).alias("matched"))

    def step(state: Column, x: Column) -> Column:
        link, own = x.bitwiseAND(F.lit(-2)), x.bitwiseAND(F.lit(1)) == 0
        open_ = F.when(link == state["link"], state["open"]).otherwise(F.lit(0))
        met = ~own & (open_ > 0)
        left = F.when(own, open_ + 1).otherwise(F.when(met, open_ - 1).otherwise(F.lit(0)))
        return F.struct(link.alias("link"), left.alias("open"), (state["matched"] + met.cast("int")).alias("matched"))

    matched = F.aggregate(both, start, step, lambda state: state["matched"])
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(_bind(matched, lambda m: m / (total - m)))


#: Quantiles of the ids that the driver holds at most, whatever the corpus' size.
QUANTILES = 1_000


def _ring(rows: DataFrame, per_bucket: int) -> DataFrame:
    """Add bucket and guest: neighbours by descending id share a bucket.

    At most QUANTILES ranges of ids between quantiles are known to the driver,
    with their bounds and counts.  Each is divided evenly into buckets of about
    ``per_bucket`` rows, so there are as many buckets as the corpus asks for.
    The largest id of each bucket also goes, as a guest, to the next bucket of
    larger ids, whose last document it follows; the very largest goes to the
    lowest bucket.
    """
    total = rows.count()
    count = max(-(-total // per_bucket), partitions(rows.sparkSession))
    ranges = max(1, min(count, total, QUANTILES))
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / ranges for i in range(1, ranges)], 0.25 / ranges))) if ranges > 1 else []
    number = F.expr(f"size(filter(array({','.join(f'{int(c)}L' for c in cuts)}), c -> c < doc_id))") if cuts else F.lit(0)
    placed = rows.withColumn("range", F.coalesce(number, F.lit(-1)))  # null ids come last
    found = placed.groupBy("range").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count("*").alias("n")).orderBy("range").collect()
    begin, lines = 0, []
    for r in found:
        within = max(1, -(-r.n // per_bucket)) if r.low is not None else 1
        lines.append((r.range, r.low or 0, (r.high or 0) - (r.low or 0) + 1, within, begin))
        begin += within
    if not lines:
        return placed.drop("range").withColumns({"bucket": F.lit(0).cast("long"), "guest": F.lit(False)})
    of = lambda i: F.element_at(F.array(*[F.lit(x[i]).cast("long") for x in lines]), F.array_position(F.array(*[F.lit(x[0]) for x in lines]), F.col("range")).cast("int"))
    # Ids of a range lie in low..low + width - 1; doubles keep the order.
    inner = F.least(F.floor((F.col("doc_id") - of(1)).cast("double") * of(3) / of(2)), of(3) - 1)
    keyed = placed.withColumn("bucket", of(4) + F.coalesce(inner, F.lit(0))).drop("range")
    tops = keyed.groupBy("bucket").agg(F.max("doc_id").alias("top"))
    # A row per bucket, a two-thousandth of the corpus: the one order over all of it.
    tops = materialize(tops.select("bucket", "top", F.lead("bucket").over(Window.orderBy("bucket")).alias("host")), "syncmer-tops")
    tops = tops.select(F.col("bucket").alias("own"), "top", F.coalesce("host", F.lit(tops.agg(F.min("bucket")).first()[0])).alias("host"))
    met = keyed.join(tops, (F.col("bucket") == F.col("own")) & F.col("doc_id").eqNullSafe(F.col("top")))
    # The last document of a bucket is followed by the largest of the next lower one.
    guests = met.select(*rows.columns, F.col("host").alias("bucket"), F.lit(True).alias("guest"))
    return keyed.withColumn("guest", F.lit(False)).unionByName(guests)


def edit_experiment(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", per_bucket: int = 2_000) -> DataFrame:
    """Fingerprint each text, its edited text and the next document's text.

    The edit replaces the last third of a text's characters by the first as
    many, or all, of the next document's, by descending id, the first
    document following the last.  One shuffle brings neighbours together.
    """
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    # Anchors are found after the shuffle, which moves texts alone.
    placed = _ring(rows, per_bucket).repartition("bucket").withColumn("anchors", anchors(F.col("text")))
    placed = placed.withColumn("links", links(F.col("anchors")))
    order = Window.partitionBy("bucket").orderBy("guest", F.desc_nulls_last("doc_id"), F.xxhash64("text"))
    following = F.lead(F.struct("text", "links")).over(order)
    met = placed.withColumn("following", following).where("not guest")
    # A lone document, and one in a bucket whose guest is a copy of its id, follows itself.
    met = met.withColumn("following", F.coalesce("following", F.struct("text", "links")))
    met = met.withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 3).cast("int")
    head = F.substring("text", F.lit(1), (F.col("n_chars") - cut).cast("int"))
    met = met.withColumn("edited", F.concat(head, F.substring(F.col("following.text"), F.lit(1), cut)))
    met = met.withColumn("edited_anchors", anchors(F.col("edited")))
    met = met.withColumn("edited_links", links(F.col("edited_anchors")))
    return met.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        render(F.col("anchors")).alias("fingerprint"),
        render(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"),
        likeness(F.col("links"), F.col("following.links")).alias("near_next"),
    )
