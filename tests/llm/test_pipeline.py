"""The pipeline's stages, held against their operators' decisions, and against plain Python on a small table."""

import collections
import re
import zlib

import corpus_pipeline
import numpy as np
import tokenizers
from docloom.llm import lines, mixing, neardup, queries
from pyspark.sql import functions as F
from test_operators import brute_near

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES][:2] == ["quality classifier", "line dedup"]
    stage = dict(corpus_pipeline.STAGES)
    good = stage["quality classifier"](spark, docs, SF).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    clean = docs.join(labels, "doc_id", "left_semi")
    assert good.join(clean, "doc_id", "left_semi").count() >= 0.97 * clean.count()

    thin = stage["line dedup"](spark, good, SF).cache()
    lost = {(r.doc_id, r.line_no) for r in lines.duplicate_lines(good).where("not kept").collect()}
    want = {}
    for r in good.collect():
        own = r.text.split("\n")
        rest = [x for n, x in enumerate(own) if (r.doc_id, n) not in lost]
        if len(rest) == len(own) or any(x.strip() for x in rest):
            want[r.doc_id] = "\n".join(rest)
    assert thin.columns == columns and {r.doc_id: r.text for r in thin.collect()} == want

    single = stage["MinHash near-dedup"](spark, thin, SF).cache()
    gone = {r.doc_id for r in neardup.near_duplicates(thin, 80).where("not kept").collect()}
    assert {r.doc_id for r in single.collect()} == set(want) - gone

    mixed = stage["mixing sources to target weights"](spark, single, SF).cache()
    copies = {r.doc_id: r.copies for r in mixing.mix(single).collect() if r.copies}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert mixed.columns == columns and got == copies

    packed = stage["best-fit packing"](spark, mixed, SF).toPandas()
    assert packed.groupby("doc_id").piece.apply(lambda p: (p == 0).sum()).to_dict() == copies
    for _, p in packed.groupby("sequence_id"):
        at = 0
        for r in p.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 2048


def plain_line_dedup(rows):
    """Texts without the lines that are equal or similar to an earlier one; None for a document that goes."""
    places = sorted((i is None, i or 0, n, text, line) for i, text, *_ in rows for n, line in enumerate((text or "").split("\n")) if line.strip(" \t\n\x0b\x0c\r"))
    first = {}
    for last, i, n, text, line in places:
        first.setdefault(line, (last, i, n, text))
    sets = {x: {x[j : j + 5] for j in range(len(x) - 4)} or {x} for x in first}
    parent, names = {}, list(first)

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both) and root(a) != root(b):
                parent[root(a)] = root(b)
    heads = {}
    for x in names:
        heads[root(x)] = min(heads.get(root(x), first[x]), first[x])
    out = []
    for i, text, *_ in rows:
        own = (text or "").split("\n")
        rest = [x for n, x in enumerate(own) if not x.strip(" \t\n\x0b\x0c\r") or heads[root(x)] == (i is None, i or 0, n, text)]
        changed = len(rest) < len(own)
        out.append(None if changed and not "".join(rest).strip(" \t\n\x0b\x0c\r") else "\n".join(rest) if changed else text)
    return out


def test_stages_against_plain_python(spark):
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), int(rng.integers(2, 9))))
    line = lambda n: " ".join(word() for _ in range(n))
    base, rows = [line(int(rng.integers(1, 25))) for _ in range(25)], []
    for i in range(70):
        own = [base[int(rng.integers(25))] if rng.random() < 0.5 else line(int(rng.integers(2, 30))) for _ in range(int(rng.integers(0, 6)))]
        own = [x + "q" if rng.random() < 0.2 else x for x in own]
        text = "\n".join(own) if rng.random() < 0.9 else None
        rows.append((i if i % 9 else None, text, "en", None if i % 11 == 0 else f"s{i % 4}", len(text or ""), "a", i, "b"))
    long = line(60)
    rows += [(200 + k, " ".join(long.split()[k:]), "en", "s1", 0, "a", 200 + k, "b") for k in range(3)] + [(300, "日本語の行。" * 9, "ja", "s2", 0, "", 300, ""), rows[4], rows[5]]
    schema = "doc_id long, text string, lang string, source string, n_chars long, lost string, position int, copy string"
    docs = spark.createDataFrame(rows, schema).repartition(3)
    stage = dict(corpus_pipeline.STAGES)

    thin = stage["line dedup"](spark, docs, SF)
    want = [(r[0], t, *r[2:4], r[4] if t == r[1] else len(t), *r[5:]) for r, t in zip(rows, plain_line_dedup(rows), strict=True) if t is not None or r[1] is None]
    assert thin.columns == docs.columns and collections.Counter(map(tuple, thin.collect())) == collections.Counter(want)

    single = stage["MinHash near-dedup"](spark, docs, SF)
    texts = {r[0]: r[1] for r in rows if r[0] is not None}
    component = {i: c for i, (_, c) in brute_near(sorted(texts.items()), 80).items()}
    kept = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    assert single.columns == docs.columns and collections.Counter(map(tuple, single.collect())) == collections.Counter(kept) and len(kept) < len(rows)

    mixed = stage["mixing sources to target weights"](spark, docs, SF)
    got, times = collections.Counter(map(tuple, mixed.collect())), collections.Counter(rows)
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    own, taken = collections.Counter(), collections.Counter()
    for r in rows:
        own[r[3]] += size(r)
    for r, n in got.items():
        taken[r[3]] += n * size(r)
        assert n <= 3 * times[r]
    names = sorted(own, key=lambda s: (s is None, s or ""))
    target = dict(zip(names, mixing.targets([own[s] for s in names], [n % 3 + 1 for n in range(len(names))], 3), strict=True))
    assert mixed.columns == docs.columns and all(abs(taken[s] - target[s]) <= max(map(size, rows)) for s in names)

    packed = stage["best-fit packing"](spark, docs, SF).collect()
    library, pieces = tokenizers.Tokenizer.from_file(queries.tokenizer_file()), collections.Counter()
    for r in rows:
        ids = np.array([*library.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4")
        for n in range(0, len(ids), 2048):
            pieces[r[0], n // 2048, n, len(ids[n : n + 2048]), zlib.crc32(ids[n : n + 2048].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == pieces

    empty = docs.limit(0)
    for name in ("line dedup", "MinHash near-dedup", "mixing sources to target weights", "best-fit packing"):
        assert stage[name](spark, empty, SF).count() == 0
    good = stage["quality classifier"](spark, spark.createDataFrame(rows + [(None, None, None, None, None, None, None, None)], schema), SF)
    assert good.columns == docs.columns and good.count() <= len(rows) + 1 and good.where(F.col("text") == long).count() <= 1


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert re.match("op|pipeline", "pipeline")
