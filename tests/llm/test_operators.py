"""Operators on small tables: nulls, empty and long texts, ties, repeats, clashing columns; and brute force."""

import collections
import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import langid, licenses, lines, mixing, neardup, packing, quality, queries, syncmers, topk, warc
from docloom.llm.runtime import components_within, connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rank int, bucket string, key string"
BASE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeats; further columns whose names operators use themselves."""
    texts = {
        1: BASE, 2: BASE, 3: BASE + " phi", 4: "", 5: None, 6: "short text", 7: "short text", 8: " \t\n ", 9: "x" * 5000,
        10: "word " * 20000, 11: "\n\n" + BASE + "\n\nA line of its own that nobody else has, number eleven.\n", 12: "日本語のテキスト。" * 30,
        13: BASE.upper(), 14: "é" * 40 + " Released under the MIT License.",
    }
    rows = [(i, t, "en" if i % 2 else "fr", f"s{i % 3}" if i != 6 else None, len(t or ""), i, "b", "k") for i, t in texts.items()]
    rows += [(None, "no id here, one two three four five six", None, None, None, None, None, None), rows[5]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def test_components(spark):
    rng = np.random.default_rng(0)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(30)] + [(7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    nodes = {x for p in pairs for x in p if p[0] != p[1]}
    assert got == {x: root(x) for x in nodes}
    # One task's union-find and the distributed one agree, however many links there are.
    edges = spark.createDataFrame(pairs, "a long, b long")
    for most in (0, 10**6):
        assert {r.node: r.component for r in components_within(edges, most=most).collect()} == got


def test_packing(spark, odd, nothing):
    pieces = packing.pack_documents(odd, queries.tokenizer_file(), 64).toPandas()
    assert len(packing.pack_documents(nothing, queries.tokenizer_file(), 64).collect()) == 0
    assert sorted(pieces.loc[pieces.doc_id.isin([4, 5]), "length"]) == [1, 1]
    for _, p in pieces.groupby("sequence_id"):
        at = 0
        for r in p.sort_values("offset").itertuples():
            assert r.offset == at
            at += r.length
        assert at <= 64
    for doc, p in pieces[pieces.doc_id.notna() & (pieces.doc_id != 6)].groupby("doc_id"):
        p = p.sort_values("piece")
        assert p.start.tolist() == [64 * i for i in range(len(p))] and (p.length[:-1] == 64).all(), doc
    assert (pieces.doc_id == 6).sum() == 2 and pieces.doc_id.isna().sum() == 1


def test_packing_against_the_library_and_plain_best_fit(spark):
    import bisect
    import zlib

    import tokenizers

    sf = "/root/testdata/sf0.001"
    library = tokenizers.Tokenizer.from_file(queries.tokenizer_file())
    want, lengths = {}, []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for n, start in enumerate(range(0, len(ids), 2048)):
            part = np.array(ids[start : start + 2048], "<u4")
            want[r.doc_id, n] = (start, len(part), zlib.crc32(part.tobytes()))
            lengths.append(len(part))
    got = queries.op1_best_fit_packing(spark, sf).collect()
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in got} == want and len(got) == len(want)
    free: list[int] = []  # of each open sequence, sorted
    for n in sorted(lengths, reverse=True):
        at = bisect.bisect_left(free, n)
        space = free.pop(at) if at < len(free) else 2048
        bisect.insort(free, space - n)
    assert len({r.sequence_id for r in got}) == len(free)


def test_mixing_query_against_plain_arithmetic(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for i, r in docs.items()}
    own = collections.Counter()
    for i, r in docs.items():
        own[r.source] += size[i]
    names = sorted(own, key=lambda s: (s is None, s or ""))
    weight = {s: n % 3 + 1 for n, s in enumerate(names)}
    target, open_ = {}, set(names)
    while open_:
        left = sum(own.values()) - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * own[s]}
        target |= {s: 3 * own[s] for s in over} if over else share
        open_ -= over or open_
    got = queries.op10_mixing(spark, sf).collect()
    assert len(got) == len(docs)
    taken = collections.Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (size[r.doc_id], own[s]) and abs(r.target - target[s]) < 1e-6
        whole = int(target[s] // own[s])
        assert r.taken in ((whole * r.size, (whole + 1) * r.size) if whole < 3 else (3 * r.size,))
        taken[s] += r.taken
    largest = {s: max(size[i] for i in docs if docs[i].source == s) for s in names}
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in names)


def test_mixing(spark, odd, nothing):
    assert mixing.mix(nothing).count() == 0
    plan = mixing.mix(odd).toPandas()
    assert len(plan) == 16 and (plan.taken <= 3 * plan["size"]).all() and (plan["size"][plan.doc_id == 5] == 0).all()
    again = mixing.mix(odd.repartition(5)).toPandas()
    key = lambda p: sorted(map(str, zip(p.doc_id, p.taken, p.position, strict=True)))
    assert key(plan) == key(again)
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 17 + 1).cast("int")).alias("text"), F.concat(F.lit("s"), F.col("id") % 5).alias("source"))
    plan = mixing.mix(many)
    for r in plan.groupBy("source", "target").agg(F.sum("taken").alias("t")).collect():
        assert abs(r.t - r.target) <= 17
    copies = mixing.schedule_copies(plan).toPandas()
    assert copies.position.between(0, 1).all() and len(copies) == plan.agg(F.sum("copies")).first()[0]
    # The running demand follows the schedules' integrals: source s1 weighs 1 + 2t, of integral 2.
    own = copies.merge(plan.toPandas()[["doc_id", "source", "target"]], on="doc_id")
    s1 = own[own.source == "s1"]
    for t in (0.25, 0.5, 0.75):
        assert abs(s1["size"][s1.position <= t].sum() / s1.target.iloc[0] - (t + t * t) / 2) < 0.02
    positions = [r.position for r in mixing.range_sorted(mixing.schedule_copies(plan), "position").collect()]
    assert positions == sorted(positions)


def test_mixed_documents_with_null_and_repeated_ids(spark, odd, nothing):
    assert mixing.mixed_documents(nothing).count() == 0
    rows = [(i if i < 30 else None if i < 40 else 50, f"w{i} " * (i % 7 + 1), f"s{i % 2}", i) for i in range(48)]
    rows += [rows[3], rows[3], (None, None, "s0", 90), (None, "lone", None, 91)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, copy int").repartition(3)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    got, times = collections.Counter(map(tuple, mixed.collect())), collections.Counter(rows)
    assert set(got) <= set(rows) and all(n <= 3 * times[r] for r, n in got.items())
    want = collections.Counter()
    for r in mixing.mix(docs, keep=["copy"]).collect():
        want[r["copy"]] += r.copies
    assert collections.Counter(mixed.rdd.map(lambda r: r["copy"]).collect()) == +want
    for source in ("s0", "s1", None):
        target = mixing.mix(docs).where(F.col("source").eqNullSafe(source)).first().target
        assert abs(sum(n * len((r[1] or "").split()) for r, n in got.items() if r[2] == source) - target) <= 7
    assert any(r[0] is None for r in got)


def test_warc(spark):
    rows = [(1, "u", "x" * 200), (2, None, "x" * 200), (3, "u", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"), (7, "u", "é" * 60), (0, "u", "x" * 200), (8, "u", "y" * 3_000_000)]
    pages = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, payload_digest string, salt int")
    got = {r.page_id: r for r in warc.round_trip(pages).collect()}
    for i, _, html in rows:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), hashlib.sha256(data).hexdigest())
        assert got[i].record_type == "response" and bytes(got[i].payload) == data if i not in (1, 2) else got[i].refers_to == 0
    assert warc.round_trip(pages.limit(0)).count() == 0
    # Repeated rows of one id: the smallest id is the response, in each of its rows; so the ids' records agree.
    again = [(r.page_id, r.record_type, r.refers_to) for r in warc.round_trip(pages.unionByName(pages.where("page_id in (0, 1)"))).collect()]
    assert sorted(again) == sorted([(i, got[i].record_type, got[i].refers_to) for i in got] + [(0, "response", None), (1, "revisit", 0)])


def test_topk(spark):
    vectors = [(i, [float(i % 7) / 10, -0.3, 0.5]) for i in range(120)]
    vectors += [(200, None), (250, [0.1, None, 0.2]), (300, [float("nan"), 0.0, 0.0]), (350, [float("inf"), 0.0, 0.0]), (400, [0.1])]
    df = spark.createDataFrame([(i, v, "x") for i, v in vectors], "vec_id long, embedding array<float>, rank string")
    df = df.unionByName(df.where("vec_id in (0, 7, 50)"))  # equal rows count once
    got = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, block=16, query_block=2).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["vec_id"], r.score))
    x = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors[:120]}
    for q in (0, 50, 100):
        want = sorted(((i, int(x[i] @ x[q])) for i in x if i != q), key=lambda p: (-p[1], p[0]))[:5]
        assert got[q] == want
    assert set(got) == {0, 50, 100} and topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def brute_near(rows, percent):
    sets = {i: frozenset(tuple(w[j : j + 5]) for j in range(len(w) - 4)) if len(w := words(t)) >= 5 else frozenset([tuple(w)] if w else []) for i, t in rows}
    parent = {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in ids}


def edited(rng, base, edits):
    w = base.split()
    for _ in range(edits):
        w[rng.integers(len(w))] = f"new{rng.integers(10**6)}"
    return " ".join(w)


def test_near_duplicates(spark, odd, nothing):
    assert neardup.near_duplicates(nothing).count() == 0
    got = neardup.near_duplicates(odd, 85).collect()
    rows = [(r.doc_id, r.text) for r in odd.collect() if r.doc_id is not None]
    want = brute_near(rows, 85)
    assert len(got) == 16 and all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert [(r.component_id, r.kept) for r in got if r.doc_id is None] == [(None, True)]
    # A group of edited copies, whose links run over the original in the middle of the ids.
    rng = np.random.default_rng(1)
    base = " ".join(f"w{i}" for i in range(150))
    texts = [edited(rng, base, int(rng.integers(1, 5))) for _ in range(120)]
    texts[60] = base
    texts += [edited(rng, texts[3], 1) for _ in range(20)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_near(list(enumerate(texts)), 85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(df, 85).collect()} == want
    kept = neardup.drop_near_duplicates(df.withColumn("lang", F.lit("x")), 85)
    assert kept.columns == ["doc_id", "text", "lang"] and kept.count() == len({c for _, c in want.values()})


def brute_lines(rows, percent):
    first = {}
    for i, t in sorted(rows):
        for n, line in enumerate((t or "").split("\n")):
            if line.strip():
                first.setdefault(line, (i, n))
    sets = {x: {x[j : j + 5] for j in range(len(x) - 4)} if len(x) >= 5 else {x} for x in first}
    parent, names = {}, list(first)

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for n, a in enumerate(names):
        for b in names[:n]:
            both = len(sets[a] & sets[b])
            if 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                if x != y:
                    parent[x] = y
    heads = {}
    for x in names:
        heads[root(x)] = min(heads.get(root(x), first[x]), first[x])
    return set(heads.values())


def test_lines(spark, odd, nothing):
    assert lines.duplicate_lines(nothing).count() == 0
    rng = np.random.default_rng(4)
    base = [" ".join("".join(rng.choice(list("abcdefghij"), 5)) for _ in range(12)) for _ in range(30)]
    texts = []
    for n in range(40):
        own = [base[int(rng.integers(30))] for _ in range(4)] + [base[n % 30][:-3] + "zzz", "", "tail" if n % 2 else "Tail"]
        texts.append("\n".join(own))
    rows = list(enumerate(texts)) + [(99, None), (100, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.duplicate_lines(df).collect()
    assert len(got) == 40 * 7 + 2
    kept = {(r.doc_id, r.line_no) for r in got if r.kept and r.component_id is not None}
    want = brute_lines(rows, 80)
    assert len(kept ^ want) <= 0.01 * len(want)
    assert all(r.kept for r in got if r.component_id is None)
    full = odd.where("doc_id is not null")
    out = {r.doc_id: r for r in lines.drop_duplicate_lines(full).collect()}
    assert 2 not in out and out[1].text == BASE and out[11].text == "\n\n\nA line of its own that nobody else has, number eleven.\n"
    assert out[11].n_chars == len(out[11].text) and out[4].text == "" and out[5].text is None


ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyzéß", "han": "".join(chr(0x4E00 + 37 * i) for i in range(400)), "thai": "".join(chr(0x0E01 + i) for i in range(46)), "digits": "0123456789"}


def test_line_candidates_meet(spark):
    """Of pairs at or over 0.8, at least 0.99 share a bucket: by words, length, script and place of the edit."""
    rng = np.random.default_rng(8)
    for letters in ALPHABETS.values():
        for space in (" ", ""):
            for words_, size in ((1, 12), (2, 8), (4, 7), (8, 5), (20, 6), (60, 6)):
                pairs = []
                while len(pairs) < 250:
                    a = space.join("".join(rng.choice(list(letters), size)) for _ in range(words_))
                    b = a
                    for _ in range(int(rng.integers(1, 1 + max(1, len(a) // 45)))):
                        at, new = int(rng.integers(len(b) + 1)), str(rng.choice(list(letters)))
                        b = [b[:at] + new + b[at + 1 :], b[:at] + new + b[at:], b[:at] + b[at + 1 :]][int(rng.integers(3))]
                    if rng.random() < 0.5:
                        b = [str(rng.choice(list(letters))) + b[1:], b[:-1]][int(rng.integers(2))]
                    x, y = ({t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (a, b))
                    if a != b and 100 * len(x & y) >= 80 * len(x | y):
                        pairs.append((a, b))
                codes = lines._codes("".join(a + b for a, b in pairs))
                ends = np.cumsum([len(t) for p in pairs for t in p])
                keys = lines.band_keys(codes, np.append(0, ends[:-1]), ends)
                met = (keys[::2] == keys[1::2]).any(1).mean()
                assert met >= 0.99, (space, words_, size, met)


def similar_pairs(rng, letters, space, words_, size, n):
    """Pairs of lines at or over 0.8, edited anywhere."""
    pairs = []
    while len(pairs) < n:
        a = space.join("".join(rng.choice(list(letters), size)) for _ in range(words_))
        b = a
        for _ in range(int(rng.integers(1, 1 + max(1, len(a) // 45)))):
            at, new = int(rng.integers(len(b) + 1)), str(rng.choice(list(letters)))
            b = [b[:at] + new + b[at + 1 :], b[:at] + new + b[at:], b[:at] + b[at + 1 :]][int(rng.integers(3))]
        if rng.random() < 0.5:
            b = [str(rng.choice(list(letters))) + b[1:], b[:-1]][int(rng.integers(2))]
        x, y = ({t[i : i + 5] for i in range(len(t) - 4)} or {t} for t in (a, b))
        if a != b and 100 * len(x & y) >= 80 * len(x | y):
            pairs.append((a, b))
    return pairs


def test_line_keys_meet_natively(spark):
    """As ``test_line_candidates_meet``, for the keys that Spark computes; and lines that repeat themselves meet those that don't."""
    rng = np.random.default_rng(9)
    pairs = []
    for letters in ALPHABETS.values():
        for space in (" ", ""):
            for words_, size in ((1, 12), (2, 8), (4, 7), (8, 5), (12, 7), (20, 6), (60, 6)):
                pairs += [((space, words_, size), *p) for p in similar_pairs(rng, letters, space, words_, size, 40)]
    for size in (5, 20, 60, 78, 95, 110, 125, 300):
        own = ["".join(rng.choice(list(ALPHABETS["latin"]), size)) for _ in range(40)]
        pairs += [(("repeated", size), x * 2, x * int(rng.integers(3, 30))) for x in own]
    flat = list({t for _, a, b in pairs for t in (a, b)})
    table = lines.distinct_lines(spark.createDataFrame([("\n".join(flat),)], "text string")).cache()
    rep = {r.line: r.rep for r in table.collect()}
    keys, sketches = collections.defaultdict(set), lines.sketched(table.withColumnRenamed("line", "payload")).cache()
    for r in lines.line_keys(table, lines.repetitive(table)).collect():
        keys[r.rep].add(r.key)
    met = collections.defaultdict(list)
    for kind, a, b in pairs:
        met[kind].append(bool(keys[rep[a]] & keys[rep[b]]))
    assert all(sum(x) >= 0.95 * len(x) for x in met.values()) and sum(map(sum, met.values())) >= 0.995 * len(pairs)
    both = spark.createDataFrame([(rep[a], rep[b]) for _, a, b in pairs], "a long, b long")
    both = both.join(sketches.alias("l"), F.expr("a = l.rep")).join(sketches.alias("r"), F.expr("b = r.rep"))
    assert both.where(lines.may_be_similar("l", "r", 80)).count() == len(pairs)  # sketches rule no similar pair out


def test_shared_keys_are_dealt_in_parts(spark, monkeypatch):
    """Only a part of the keys is in shuffle files at a time, and no key or row is lost by that."""
    rng = np.random.default_rng(10)
    rows = {(int(k) * 7919 - 400_000, int(r)) for k, r in zip(rng.integers(0, 900, 2000), rng.integers(-500, 500, 2000), strict=True)}
    written = []
    monkeypatch.setattr(lines, "sweep", lambda s: written.append(s))
    got = [tuple(r) for r in lines.shared_keys(spark.createDataFrame(sorted(rows), "key long, rep long"), "test-members").collect()]
    count = collections.Counter(k for k, _ in rows)
    assert sorted(got) == sorted(x for x in rows if count[x[0]] > 1)
    assert len(written) > 3  # the keys as they come, and then part by part


def test_verification_has_tasks_for_its_shingles(spark, monkeypatch):
    """Pairs of few bytes and many shingles aren't put together in one task."""
    monkeypatch.setattr(lines, "TASK_SHINGLES", 1000, raising=False)
    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list(ALPHABETS["latin"]), 300)) for _ in range(60)]
    items = spark.createDataFrame([(2 * i + j, x + "zz" * j) for i, x in enumerate(texts) for j in (0, 1)], "rep long, payload string")
    pairs = spark.createDataFrame([(2 * i, 2 * i + 1, 594) for i in range(60)] + [(2 * i, 2 * i + 2, 592) for i in range(59)], "a long, b long, n long")
    got = lines.verified(pairs, items, 80).select("a", "b", F.spark_partition_id().alias("task")).collect()
    assert sorted((r.a, r.b) for r in got) == [(2 * i, 2 * i + 1) for i in range(60)]
    assert len({r.task for r in got}) > 20


def test_lines_without_python_on_executors(spark, monkeypatch):
    def refuse(*_, **__):
        raise AssertionError("Python on the executors")

    for name in ("mapInArrow", "mapInPandas"):
        monkeypatch.setattr(type(spark.range(0)), name, refuse)
    near = "the quick brown fox jumps over the lazy dog near the river bank"
    group = [near + x for x in ("", "s", "x", " y")] + ["another line that stands alone in this table, far from the others"]
    docs = spark.createDataFrame(list(enumerate(group)), "doc_id long, text string")
    assert [r.doc_id for r in lines.duplicate_lines(docs).where("kept").orderBy("doc_id").collect()] == [0, 4]
    assert lines.drop_duplicate_lines(docs).count() == 2


@pytest.mark.parametrize("least,most", [(1, 4), (5, 8), (9, 14)])
@pytest.mark.parametrize("space", [" ", ""])
def test_lines_recall_by_word_count(spark, least, most, space):
    rng = np.random.default_rng(least)
    texts = []
    for _ in range(60):
        line = space.join("".join(rng.choice(list("abcdefghijklmnopqrstuvwxyzéß日"), 6)) for _ in range(int(rng.integers(least, most + 1))))
        at = int(rng.integers(len(line)))
        texts += [line, "x" + line, line + "x", "y" + line[1:], line[:at] + "z" + line[at + 1 :], line[:at] + "w" + line[at:]]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {(r.doc_id, r.line_no) for r in lines.duplicate_lines(df).where("kept").collect()}
    want = brute_lines(rows, 80)
    assert len(kept ^ want) <= 0.01 * len(want)


def test_lines_of_null_and_repeated_ids(spark):
    near = "the quick brown fox jumps over the lazy dog near the river bank"
    rows = [(1, near), (7, near + "\nshared tail line"), (7, "a line nobody else has at all\nanother own line"), (None, near + "s"), (None, near + "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = lines.duplicate_lines(df).collect()
    assert len(got) == 7 and sorted((r.doc_id or 0, r.line_no) for r in got if not r.kept) == [(0, 0), (0, 0), (7, 0)]
    out = {tuple(r) for r in lines.drop_duplicate_lines(df).collect()}
    assert out == {rows[0], (7, "shared tail line"), rows[2]}  # rows without an id lose their lines like others


def test_syncmers(spark, odd, nothing):
    assert syncmers.edit_experiment(nothing).count() == 0
    rows = odd.where("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r.doc_id: r for r in syncmers.edit_experiment(rows, per_bucket=2).collect()}
    texts = {r.doc_id: r.text or "" for r in rows.collect()}
    order = sorted(texts, reverse=True)
    for a, b in zip(order, order[1:] + order[:1], strict=True):
        cut = len(texts[a]) // 3
        want = texts[a][: len(texts[a]) - cut] + texts[b][:cut]
        assert got[a].n_chars == len(texts[a]) and got[a].edited_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert (got[a].fingerprint == got[a].edited_fingerprint) or texts[a] != want
        assert 0 <= got[a].near_edited <= 1 and 0 <= got[a].near_next <= 1
    assert got[1].fingerprint == got[2].fingerprint and got[2].near_next == 1.0 and got[4].fingerprint == ""
    text = "a b c d e f g h i j k l m n o p q r s t u v w x y z " * 3
    found = spark.createDataFrame([(text,), ("zz yy " + text,)], "t string").select(syncmers.anchors(F.col("t")).alias("a")).collect()
    left, right = ({(p.position, p.hash) for p in r.a} for r in found)
    assert {(p + 2, h) for p, h in left} <= right  # context-free: the same anchors, moved


def test_syncmers_of_long_texts(spark):
    """A few edits show in the fingerprint, and likeness counts all anchors by their links."""
    rng = np.random.default_rng(2)
    units = [f"u{n}" for n in rng.integers(0, 3000, 20000)]
    few, moved = list(units), units[7000:] + units[:7000]
    for at in rng.choice(20000, 5, replace=False):
        few[at] = "edited"
    texts = [" ".join(w) for w in (units, few, moved)] + ["same " * 300, "same " * 200, "a b c", "a b d", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").withColumn("a", syncmers.anchors(F.col("t")))
    df = df.select("i", "a", syncmers.links(F.col("a")).alias("l"), syncmers.render(F.col("a")).alias("f")).cache()
    own = {r.i: r for r in df.collect()}
    assert own[0].f != own[1].f and len(re.findall(r"\d+\.[0-9a-f]{16}", own[0].f)) == len(own[0].a) > 5000
    x, y = df.alias("x"), df.alias("y")
    got = x.crossJoin(y).select(F.col("x.i"), F.col("y.i").alias("j"), syncmers.likeness(F.col("x.l"), F.col("y.l")).alias("n")).collect()

    def items(i):
        a = own[i].a
        return collections.Counter((p.hash, a[n + 1].hash, a[n + 1].position - p.position) if n + 1 < len(a) else (p.hash,) for n, p in enumerate(a))

    for r in got:
        p, q = items(r.i), items(r.j)
        both, total = sum((p & q).values()), sum((p | q).values())
        assert r.n == (both / total if total else 1.0), (r.i, r.j)
    near = {(r.i, r.j): r.n for r in got}
    assert 0.99 < near[0, 1] < 1 and near[0, 2] > 0.99 and near[3, 4] < 0.7 and near[5, 6] == near[0, 7] == 0


def test_quality_scores(spark, odd, nothing):
    good = [(i, f"plain text number {i} with some calm words in it", 1) for i in range(40)]
    bad = [(100 + i, f"BUY!!! NOW!!! {i} $$$ ### %%%", 0) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(7, None), (None, 1)], "doc_id long, label int")
    model = quality.train(df, labels, sample=30)
    scores = {r.doc_id: r.score for r in quality.score(df, model).collect()}
    assert min(scores[i] for i, _, _ in good) > 0.7 > max(scores[i] for i, _, _ in bad)
    assert quality.score(odd, model).count() == 16 and quality.score(nothing, model).count() == 0
    kept = quality.keep_good(df.withColumn("score", F.lit("clash")), model, 0.7)
    assert {r.doc_id for r in kept.collect()} == {i for i, _, _ in good} and kept.columns == ["doc_id", "text", "score"]


def test_quality_is_accurate_on_the_held_out_fold(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op8_quality(spark, sf).where("held_out").select("doc_id", "predicted")
    met = got.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    assert met.where("predicted = quality").count() >= 0.95 * met.count()


def test_language(spark, odd):
    sf = "/root/testdata/sf0.001"
    got = queries.op7_language(spark, sf)
    docs = got.where("doc_id is not null").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert docs.count() == 200 and docs.where("lang = truth").count() >= 190
    assert got.where("page_id is not null").count() == 50
    # Fusion against plain arithmetic.
    model = langid.from_counts({"a": np.bincount([1, 1, 2], minlength=1 << langid.BITS), "b": np.bincount([3], minlength=1 << langid.BITS)})
    rows = [(1, "abc", "a", "x", "d", "h"), (2, None, "b", "x", "d", "h"), (3, "", "", "", "", "h2"), (4, "zzz", None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, text string, declared string, suffix string, domain string, host string").fillna("")
    weighed = langid.text_evidence(df, model, False)
    favoured = {r.page_id: (r.likelihood, r.favoured) for r in weighed.collect()}
    fused = {r.page_id: r for r in langid.fuse(weighed, model).collect()}
    votes = collections.Counter(f for _, f in favoured.values() if f >= 0)
    overall = np.array([votes[j] + 1.0 for j in range(2)]) / (sum(votes.values()) + 2)
    plain = {r[0]: [x or "" for x in r[1:]] for r in rows}

    def count(place, value):
        return np.array([sum(1 for i, r in plain.items() if r[place] == value and favoured[i][1] == j) for j in range(2)], float)

    for i, r in plain.items():
        domain = count(3, r[3])
        domain = (domain + langid.KAPPA * overall) / (domain.sum() + langid.KAPPA)
        host = np.array([sum(1 for k, s in plain.items() if (s[3], s[4]) == (r[3], r[4]) and favoured[k][1] == j) for j in range(2)], float)
        host = (host + langid.KAPPA * domain) / (host.sum() + langid.KAPPA)
        total = np.array([votes[j] + 1.0 for j in range(2)])
        rate = lambda n: np.log((n + 0.02 * (1 + n.sum()) + 0.1) / total)
        score = np.log(host) + np.array(favoured[i][0]) + rate(count(1, r[1])) + rate(count(2, r[2]))
        assert fused[i].lang == "ab"[int(score.argmax())]
        assert abs(fused[i].confidence - 1 / np.exp(score - score.max()).sum()) < 1e-9


def test_language_without_rows_labels_or_hosts(spark, odd, nothing):
    empty = langid.train(nothing.select("text", "lang"))
    rows = langid.document_rows(odd)
    blank = langid.fuse(langid.text_evidence(rows, empty, False), empty).collect()
    assert len(blank) == 16 and all(r.lang is None and r.confidence is None for r in blank)
    model = langid.train(odd.select("text", "lang"))
    assert langid.fuse(langid.text_evidence(langid.document_rows(nothing), model, False), model).count() == 0
    pages = spark.createDataFrame([(1, None, None), (2, "http://a.fr/x", "<html lang='FR-fr'><p>one two"), (None, "no address", "<html"), (4, None, "")], "page_id long, url string, html string")
    found = langid.fuse(langid.text_evidence(langid.page_rows(pages), model, True), model).collect()
    assert len(found) == 4 and all(r.lang in ("en", "fr") and 0 < r.confidence <= 1 for r in found)
    assert {r.page_id: r.declared for r in langid.page_rows(pages).collect()} == {1: "", 2: "fr", None: "", 4: ""}
    nulled = rows.withColumns({c: F.lit(None).cast("string") for c in ("declared", "suffix", "domain", "host")})
    assert langid.fuse(langid.text_evidence(nulled, model, False), model).where("lang is not null").count() == 16


def test_language_is_accurate_on_texts_it_was_not_fitted_to(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = quality.fold(F.col("doc_id")) == 2
    model = langid.train(docs.where(~held).select("text", "lang"))
    rows = langid.document_rows(docs.where(held))
    got = langid.fuse(langid.text_evidence(rows, model, False), model).join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id")
    assert got.where("lang = truth").count() >= 0.95 * got.where("truth is not null").count()


def test_licenses(spark, odd, nothing):
    got = licenses.license_matches(odd).collect()
    assert [(r.doc_id, r.license, r.coverage) for r in got] == [(14, "MIT-notice", 1.0)]
    assert licenses.license_matches(nothing).count() == 0
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    wanted = {r.doc_id for r in docs.where(F.lower("text").rlike("released under the mit license|licensed under (cc|the apache)|licensed under the gnu general public")).collect()}
    assert {r.doc_id for r in licenses.license_matches(docs).collect()} == wanted
