"""Language ID by Bayesian fusion of text, markup, address and host evidence.

For each row, log posterior of a language =
  log prior of the language at the row's host, smoothed over host, domain and
  all rows
  + log likelihood of the declared markup language
  + log likelihood of the address suffix (the host's last label)
  + tempered log likelihood of the text's byte trigrams.
Priors and the likelihoods of markup and suffix are grouped counts over all
rows, by the language that the text alone favours.

Trigram tables are fitted on all labelled texts; each task counts, and the
grouped counts, bounded by the hashed trigrams of each language, are the model.

Defined cases: a null text has no trigrams, so the other evidence decides; a
null declaration, address or host counts as an empty one, which is a value of
its own; a label that is null takes no part in fitting; without any label each
language is null; more than ``MOST`` labels are an error; repeated rows count
each; an empty table gives no rows; columns that aren't named are not read.
Markup is read in time proportional to its length, also if tags, scripts or
comments never end: such an opening is an ordinary tag, and a tag without an
end is text.
"""

from __future__ import annotations

import html as markup
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import materialize, ship, slices
from .textops import arrow_buffers

BITS = 16
#: Trigrams that a text's likelihood counts as at most: neighbours aren't independent.
EFFECTIVE = 40.0
#: Pseudo-counts by which a host leans on its domain, and a domain on all rows.
KAPPA = 20.0

#: Labels that a model tells apart at most; each takes 2**BITS numbers.
MOST = 256

_OPENING = re.compile(r"<(?:(script|style|noscript)\b|(!--))", re.I)
_CLOSING = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "noscript")} | {"!--": re.compile("-->")}


def page_text(html: str | None) -> str:
    """The visible text of a page."""
    html = html or ""
    parts, at, endless = [], 0, set()
    while (tag := html.find("<", at)) >= 0:
        parts.append(html[at:tag])
        opening = _OPENING.match(html, tag)
        kind = (opening[1] or opening[2]).lower() if opening else None
        end = -1
        if kind and kind not in endless:
            closing = _CLOSING[kind].search(html, opening.end())
            if closing:
                end = closing.end()
            else:
                endless.add(kind)
        if end < 0:
            end = html.find(">", tag) + 1
            if not end:
                at = tag
                break
        parts.append(" ")
        at = end
    parts.append(html[at:])
    return markup.unescape("".join(parts))


def declared_language(html: Column) -> Column:
    """The primary tag of the first html element's ``lang`` attribute, lower case, or ''."""
    html = F.coalesce(html, F.lit(""))
    begin = F.regexp_instr(html, F.lit(r"(?i)<html\b"))
    tag = F.when(begin > 0, F.substring_index(F.substring(html, begin, F.char_length(html)), ">", 1)).otherwise(F.lit(""))
    return F.lower(F.regexp_extract(tag, r"(?is)\slang\s*=\s*[\"']?([A-Za-z]+)", 1))


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), F.lit("")))


@dataclass
class TrigramModel:
    languages: list[str]
    #: Log probability of each hashed trigram, a row per language.
    weights: np.ndarray

    def likelihoods(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Tempered log likelihoods, a row per text, and trigram counts."""
        numbers, counts = trigrams(column)
        bounds = np.concatenate([[0], np.cumsum(counts)])
        out = np.zeros((len(counts), len(self.languages)))
        for j, weight in enumerate(self.weights):
            total = np.concatenate([[0.0], np.cumsum(weight[numbers], dtype=np.float64)])
            out[:, j] = total[bounds[1:]] - total[bounds[:-1]]
        return out * np.where(counts > EFFECTIVE, EFFECTIVE / np.maximum(counts, 1), 1.0)[:, None], counts


def trigrams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of lower-cased letters and gaps, and how many each text has."""
    import pyarrow.compute as pc

    buffer, offsets = arrow_buffers(pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), "")))
    data = buffer[int(offsets[0]) : int(offsets[-1])]
    offsets = offsets - offsets[0]
    letters = np.where(((data >= 97) & (data <= 122)) | (data >= 128), data, 32).astype(np.uint32)
    n = len(letters)
    code = np.zeros(n, np.uint32)
    if n > 2:
        code[: n - 2] = letters[:-2] | letters[1:-1] << np.uint32(8) | letters[2:] << np.uint32(16)
    use = np.zeros(n, bool)
    if n > 2:
        use[: n - 2] = (letters[1:-1] != 32) | ((letters[:-2] != 32) & (letters[2:] != 32))
    for back in (1, 2):  # a trigram doesn't cross into the next text
        at = offsets[1:] - back
        use[at[(at >= 0) & (at < n)]] = False
    total = np.concatenate([[0], np.cumsum(use)])
    numbers = (code[use] * np.uint32(2654435761)) >> np.uint32(32 - BITS)
    return numbers.astype(np.int64), total[offsets[1:]] - total[offsets[:-1]]


def from_counts(counts: dict[str, np.ndarray]) -> TrigramModel:
    """Smoothed log probabilities from each language's trigram counts."""
    names = sorted(counts)
    if not names:
        return TrigramModel([], np.zeros((0, 1 << BITS), np.float32))
    table = np.stack([counts[n] for n in names]).astype(np.float64) + 0.1
    return TrigramModel(names, np.log(table / table.sum(1, keepdims=True)).astype(np.float32))


def train(labelled: DataFrame) -> TrigramModel:
    """Fit on all whole texts of (text, lang).

    Each task sums up its texts; the grouped counts that reach the driver are
    at most 2**BITS for each language.
    """
    ship(labelled.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            numbers, counts = trigrams(batch.column(0))
            names = np.array(batch.column(1).to_pylist(), object)
            owner = np.repeat(names, counts)
            for name in set(names.tolist()):
                own = np.bincount(numbers[owner == name], minlength=1 << BITS)
                sums[name] = sums[name] + own if name in sums else own
        for name, total in sums.items():
            used = np.flatnonzero(total)
            columns = [pa.array([name] * len(used), pa.string()), pa.array(used), pa.array(total[used])]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "number", "n"])

    rows = labelled.where("lang is not null").select("text", "lang").mapInArrow(count, "lang string, number long, n long")
    labels = labelled.where("lang is not null").select("lang").distinct().limit(MOST + 1).collect()
    if len(labels) > MOST:
        raise ValueError(f"there are over {MOST} labels")
    out: dict[str, np.ndarray] = {r.lang: np.zeros(1 << BITS) for r in labels}
    for r in rows.groupBy("lang", "number").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.lang][r.number] = r.n
    return from_counts(out)


def text_evidence(rows: DataFrame, model: TrigramModel, is_markup: bool) -> DataFrame:
    """Replace column ``text`` by ``likelihood``, ``trigrams`` and ``favoured``, a language number."""
    ship(rows.sparkSession)
    kept = [c for c in rows.columns if c != "text"]
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in kept) + ", likelihood array<double>, trigrams long, favoured int"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = batch.column(batch.schema.get_field_index("text"))
            if is_markup:
                texts = pa.array([page_text(t) for t in texts.to_pylist()], pa.string())
            values, counts = model.likelihoods(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()), pa.array(values.ravel()))
            favoured = pa.array(np.where(counts > 0, values.argmax(1) if model.languages else -1, -1).astype(np.int32))
            own = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, lists, pa.array(counts), favoured], names=[*kept, "likelihood", "trigrams", "favoured"])

    return rows.mapInArrow(weigh, schema)


def _counts(rows: DataFrame, column: str, size: int) -> DataFrame:
    """(column, n): how many rows of each value favour each language, as an array."""
    votes = [F.sum((F.col("favoured") == j).cast("long")).cast("double").alias(f"n{j}") for j in range(size)]
    return rows.groupBy(column).agg(*votes).select(column, F.array(*[f"n{j}" for j in range(size)]).alias("n"))


def fuse(rows: DataFrame, model: TrigramModel) -> DataFrame:
    """Add lang, confidence and text_lang to rows with text evidence, declared, suffix, domain and host.

    Hosts that hold a third of all rows are summed up before any shuffle, and
    met again in joins of narrow rows that adaptive execution can split.
    """
    size = len(model.languages)
    rows = rows.withColumns({c: F.coalesce(c, F.lit("")) for c in ("declared", "suffix", "domain", "host")})
    if not size:
        return rows.drop("likelihood", "favoured").withColumns({"lang": F.lit(None).cast("string"), "confidence": F.lit(None).cast("double"), "text_lang": F.lit(None).cast("string")})
    rows = materialize(rows, "language-rows")
    total = rows.agg(*[F.sum((F.col("favoured") == j).cast("long")).alias(f"n{j}") for j in range(size)]).first()
    overall = np.array([float(total[j] or 0) + 1.0 for j in range(size)])
    overall /= overall.sum()
    prior = F.array(*[F.lit(float(p)) for p in overall])

    def leaning(n: Column, parent: Column) -> Column:
        seen = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda x, p: (x + F.lit(KAPPA) * p) / (seen + F.lit(KAPPA)))

    domains = _counts(rows, "domain", size).withColumn("domain_prior", leaning(F.col("n"), prior)).drop("n")
    hosts = _counts(rows.withColumn("place", F.struct("domain", "host")), "place", size).select("place.domain", "place.host", "n")
    hosts = hosts.join(domains, "domain").select("domain", "host", leaning(F.col("n"), F.col("domain_prior")).alias("host_prior"))

    def conditional(column: str, alias: str) -> DataFrame:
        # P(value | language): smoothed by the value's share among all rows.
        counted = _counts(rows, column, size)
        share = F.aggregate("n", F.lit(1.0), lambda a, x: a + x)
        rated = F.transform("n", lambda x, j: F.log((x + F.lit(0.02) * share + F.lit(0.1)) / F.get(F.array(*[F.lit(float(total[i] or 0) + 1.0) for i in range(size)]), j)))
        return counted.select(column, rated.alias(alias))

    met = rows.join(hosts, ["domain", "host"], "left").join(conditional("declared", "by_markup"), "declared", "left").join(conditional("suffix", "by_suffix"), "suffix", "left")
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    scores = add(add(F.transform("host_prior", lambda p: F.log(p)), F.col("likelihood")), add(F.col("by_markup"), F.col("by_suffix")))
    met = met.withColumn("scores", scores)
    names = F.array(*[F.lit(x) for x in model.languages])
    top = F.array_max("scores")
    place = (F.array_position("scores", top) - 1).cast("int")
    weight = F.aggregate("scores", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    out = met.withColumn("lang", F.get(names, place)).withColumn("confidence", 1 / weight)
    out = out.withColumn("text_lang", F.when(F.col("favoured") >= 0, F.get(names, F.col("favoured"))))
    return out.drop("scores", "host_prior", "by_markup", "by_suffix", "likelihood", "favoured")


def page_rows(pages: DataFrame) -> DataFrame:
    """(page_id, text, declared, suffix, domain, host) of raw pages; the text is still markup."""
    host = host_of(F.col("url"))
    return pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.col("html").alias("text"),
        declared_language(F.col("html")).alias("declared"),
        F.element_at(F.split(host, r"\."), -1).alias("suffix"),
        F.array_join(F.slice(F.split(host, r"\."), F.greatest(F.size(F.split(host, r"\.")) - 1, F.lit(1)), 2), ".").alias("domain"),
        host.alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, declared, suffix, domain, host): a source stands for a host."""
    source = F.coalesce(F.col("source"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), "text", F.lit("").alias("declared"), F.lit("").alias("suffix"), F.lit("source").alias("domain"), source.alias("host")
    )
