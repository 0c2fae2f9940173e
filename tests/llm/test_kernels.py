"""Kernels against brute force: tokens, packing plans, shingles, signatures, alignment."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import langid, licenses, linkage, mixing, neardup, packing, quality, topk, warc
from docloom.llm.queries import tokenizer_file
from docloom.llm.textops import Words, arrow_buffers
from docloom.llm.tokens import WordTokenizer

ODD = ["it's 'SCARE' don't ''s ',s '' 's", "", None, "a'l l'lama I'Ve 12'34 5's", "Σίσυφος İstanbul", "x<|endoftext|>y", "étude 你好", "\x1c a", "'", "''''", ",'s x's", "word " * 3000, "é é", "٣٤ ½"]


def test_tokenizer_equals_library():
    t = WordTokenizer(tokenizer_file(), words=50)  # so few that the table is cleared on the way
    rng = random.Random(1)
    texts = ODD + [" ".join("".join(rng.choice("abché'.,1 -") for _ in range(rng.randint(1, 12))) for _ in range(40)) for _ in range(60)]
    ids, first = t.encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[first[i] : first[i + 1]].tolist() == t.library.encode(x or "", add_special_tokens=False).ids, x


@pytest.mark.parametrize("seed", range(25))
def test_plan_places_all_without_gaps(seed):
    rng = random.Random(seed)
    counts = {rng.randint(1, 64): rng.randint(1, 40) for _ in range(rng.randint(1, 30))}
    runs, total = packing.plan_best_fit(counts, 64)
    seen, rows = {}, {}
    for r in runs:
        for k in range(r.count):
            seen.setdefault(r.length, set()).add(r.rank + k)
            rows.setdefault(r.sequence + k // r.per_sequence, []).append((r.offset + k % r.per_sequence * r.length, r.length))
    assert {n: set(range(c)) for n, c in counts.items()} == seen and set(rows) == set(range(total))
    for placed in rows.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 64
    tokens = sum(n * c for n, c in counts.items())
    least = max(-(-tokens // 64), sum(c for n, c in counts.items() if n > 32))  # no packing has fewer
    assert total <= least * 11 / 9 + 1


def test_words_match_the_pattern():
    texts = ["Ab c\tD\n", "", None, " é x ", "a", "\x0b\x0c", "Zz"]
    words = Words(*arrow_buffers(pa.array(texts, pa.string())))
    got = [[bytes(words.bytes[a:b]).decode() for a, b, d in zip(words.start, words.end, words.doc, strict=True) if d == i] for i in range(len(texts))]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    assert got == [re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) for t in texts]


def test_shingle_sets_and_signatures():
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdef") for _ in range(n)) for n in (0, 1, 4, 5, 6, 40, 400)]
    values, ranges = neardup.shingle_sets(pa.array(texts), 5)
    for i, t in enumerate(texts):
        w = t.split()
        want = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
        assert ranges[i + 1] - ranges[i] == len(want)
    signature = neardup.densified(values, ranges)
    assert (signature[0] == 0).all() and all(set(signature[i].tolist()) <= set(values[ranges[i] : ranges[i + 1]].tolist()) for i in range(1, len(texts)))


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    a = np.unique(rng.integers(0, 2**63, 1000).astype(np.uint64))
    b = np.unique(np.concatenate([a[:900], rng.integers(0, 2**63, 50).astype(np.uint64)]))
    s = neardup.densified(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
    true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((s[0] == s[1]).mean() - true) < 0.12


@pytest.mark.parametrize("seed", range(6))
def test_threshold_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(-3 if seed % 2 else -200, 4 if seed % 2 else 200, (300, 8))
    ids = np.sort(rng.choice(5000, 300, replace=False))
    q, r, s = topk.threshold_search(x, ids, x[:20], ids[:20], 5)
    for i in range(20):
        score = x @ x[i]
        order = sorted((j for j in range(300) if j != i), key=lambda j: (-score[j], ids[j]))[:5]
        mine = [(a, b) for a, b, c in zip(r[q == ids[i]], s[q == ids[i]], q[q == ids[i]], strict=True)]
        assert mine == [(ids[j], score[j]) for j in order]
    none = topk.threshold_search(np.zeros((3, 2), int), np.arange(3), np.zeros((1, 2), int), np.array([1]), 5)
    assert none[1].tolist() == [0, 2]


def test_warc_records_verify():
    raw = warc.page_record(1, "http://x/\r\n", b"hello", warc.hashlib.sha256(b"hello").hexdigest(), None)
    again = warc.page_record(2, None, b"hello", warc.hashlib.sha256(b"hello").hexdigest(), 1)

    class Drip:
        def __init__(self, data):
            self.data = data

        def read(self, n):
            out, self.data = self.data[:3], self.data[3:]
            return out

    first, second = warc.read_records(Drip(raw + again))
    assert first.payload == b"hello" and second.payload is None and second.headers["WARC-Refers-To"] == "<urn:page:1>"
    with pytest.raises(warc.WarcError):
        list(warc.read_records(Drip(raw[:-9])))
    bad = zlib.compressobj(6, zlib.DEFLATED, 31)
    data = bad.compress(zlib.decompress(raw, 31).replace(b"hello\r\n\r\n", b"hellO\r\n\r\n")) + bad.flush()
    with pytest.raises(warc.WarcError):
        list(warc.read_records(Drip(data)))


def test_targets_share_everything():
    assert mixing.targets([100, 100, 100], [1, 2, 3], 3) == [50.0, 100.0, 150.0]
    got = mixing.targets([10, 1000, 0], [5, 1, 3], 3)
    assert got[0] == 30.0 and got[2] == 0.0 and abs(sum(got) - 1010) < 1e-9
    assert [mixing.integral(s) for s in mixing.DEFAULT_SCHEDULES] == [1.0, 2.0, 3.0]


def test_short_licenses_are_found_each():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    line = licenses.TEMPLATES["MIT-notice"]
    texts = [" ".join([line] * n) for n in (1, 2, 10)] + ["Released under MIT License", "Released under an MIT License", "Released under MIT License. " + line, "the under the the license"]
    found = [m for m in licenses.scan(pa.array(texts), index, 0.7) if m[1] == "MIT-notice"]
    assert [sum(m[0] == i for m in found) for i in range(len(texts))] == [1, 2, 10, 1, 1, 2, 0]
    assert [texts[2][m[5] : m[6]] for m in found if m[0] == 2] == [line[:-1]] * 10
    assert [m[4] for m in found if m[0] in (3, 4)] == [0.8, 0.8]


def test_license_alignment_finds_spans():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    text = "Überschrift! " + licenses.TEMPLATES["MIT"].replace("without restriction", "with no limits") + " tail. Released under the MIT License."
    found = {m[1]: m for m in licenses.scan(pa.array([text, None, "", "nothing here at all"]), index, 0.7)}
    assert set(found) == {"MIT", "MIT-grant", "MIT-notice"} and 0.9 < found["MIT"][4] < 1 and found["MIT-notice"][4] == 1.0
    assert text[found["MIT"][5] : found["MIT"][6]].startswith("Permission") and text[found["MIT-notice"][5] : found["MIT-notice"][6]] == "Released under the MIT License"


def test_winnow_covers_each_window():
    rng = np.random.default_rng(1)
    values, doc = rng.integers(0, 9, 200).astype(np.uint64), np.sort(rng.integers(0, 12, 200))
    kept = set(licenses.winnow(values, doc, 4).tolist())
    for i in range(197):
        if doc[i] == doc[i + 3]:
            assert any(j in kept and values[j] == values[i : i + 4].min() for j in range(i, i + 4))


def test_quality_model_separates():
    rng = random.Random(5)
    good = ["".join(rng.choice("abcdefgh ") for _ in range(200)) for _ in range(60)]
    bad = [g.upper().replace(" ", "!! ") for g in good]
    rows = list(quality.features(pa.array(good + bad)))
    labels = np.array([1] * 60 + [0] * 60)
    model = quality.fit(rows, labels, 0.5)
    scores = np.array([model.score(f) for f in rows])
    assert scores[:60].min() > 0.7 > scores[60:].max()
    assert quality.fit([], np.zeros(0, int), 1.0).score(next(quality.features(pa.array([""])))) > 0.99
    assert quality.fit(rows[60:], labels[60:], 0.0).score(rows[0]) < 0.01


def test_page_text_and_trigrams():
    assert langid.page_text("<p>a&amp;b<script>x<y</script><!-- c --> d</p>").split() == ["a&b", "d"]
    numbers, counts = langid.trigrams(pa.array(["abc", None, "", "ab", "Ünï"]))
    assert counts.tolist()[:4] == [1, 0, 0, 0] and len(numbers) == counts.sum()


def plain_page_text(html):
    """By regular expressions, for pages whose tags, scripts and comments end."""
    import html as markup

    html = re.sub(r"<(script|style|noscript)\b.*?</\1\s*>|<!--.*?-->", " ", html, flags=re.S | re.I)
    return markup.unescape(re.sub(r"<[^>]*>", " ", html))


def test_page_text_against_expressions_and_hostile_markup():
    import time

    rng = random.Random(3)
    bits = ["text &lt; x", "<p class='a'>", "</p>", "<script>var a = 1;</script >", "<STYLE>p {}</style>", "<!-- a <b> -->", "<noscript><i>n</i></noscript>", "é > ", "<br/>"]
    for _ in range(300):
        page = "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
        assert langid.page_text(page).split() == plain_page_text(page).split(), page
    begin = time.process_time()
    for hostile in ("<script " * 200_000, "<!-- " * 200_000, "<" * 1_000_000, "<script></scrip" * 100_000, "<style>" * 100_000 + "</style" + " " * 500_000, "</script" * 100_000):
        langid.page_text(hostile)
    assert time.process_time() - begin < 10
    assert langid.page_text("a <script>b") == "a  b" and langid.page_text("x <y") == "x <y"


def plain_alignment(template, text):
    """Best local alignment without a band: matched tokens."""
    best, row = (0, 0), [(0, 0)] * (len(text) + 1)
    for wanted in template:
        new = [(0, 0)]
        for j, token in enumerate(text):
            score, matched = row[j]
            cell = (score + 2, matched + 1) if token == wanted else (score - 1, matched)
            cell = max(cell, (row[j + 1][0] - 1, row[j + 1][1]), (new[j][0] - 1, new[j][1]), key=lambda c: c[0])
            new.append(cell if cell[0] > 0 else (0, 0))
            best = max(best, new[-1], key=lambda c: c[0])
        row = new
    return best[1]


def test_license_matches_of_edited_texts_against_plain_alignment():
    rng = random.Random(11)
    for name in ("MIT", "GPL-2.0", "Zlib", "MPL-2.0", "CC0-1.0"):
        index = licenses.TemplateIndex.build({name: licenses.TEMPLATES[name]})
        for edits in (0, 1, 3, 6):
            words = licenses.TEMPLATES[name].split()
            for _ in range(edits):
                at = rng.randrange(len(words))
                words[at : at + rng.choice((0, 1))] = rng.choice(([], ["edit%d" % rng.randrange(99)]))
            text = "before it some words " + " ".join(words) + " and some after"
            hashed = licenses.tokens(pa.array([text]))[0].tolist()
            matched = plain_alignment(index.token_hashes[0].tolist(), hashed)
            found = licenses.scan(pa.array([text]), index, 0.7)
            assert [m[2] for m in found] == ([matched] if matched >= 0.7 * len(index.token_hashes[0]) else []), (name, edits)


def test_templates_are_winnowed():
    index = licenses.TemplateIndex.build(licenses.TEMPLATES)
    tokens_ = sum(map(len, index.token_hashes))
    assert 0.2 * tokens_ < len(index.fingerprints) < 0.6 * tokens_


def test_quality_features_against_sets():
    texts = ["Plain words here, 12 of them.", "", "AAAA BBBB!!!", "é" * 30, "a", "ab ab ab"]
    for text, got in zip(texts, quality.features(pa.array(texts)), strict=True):
        data = text.encode()
        want = set()
        for n in quality.ORDERS:
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "little") ^ 0x9E37 * n
                want.add(code * 2654435761 % 2**32 >> 32 - quality.BITS)
        grams = got[got < 1 << quality.BITS].tolist()
        assert len(grams) == len(set(grams)) and set(grams) == want
        assert len(got) - len(grams) == 5


class Sorted:
    """Rows that stand for a DataFrame sorted by key, in batches of ``step``."""

    sparkSession = None

    def __init__(self, rows, step):
        self.rows, self.step = rows, step

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, f, _):
        batch = pa.RecordBatch.from_arrays([pa.array(self.rows[:, 0]), pa.array(self.rows[:, 1])], names=["key", "rep"])
        return [r for b in f(batch.slice(i, self.step) for i in range(0, batch.num_rows, self.step)) for r in zip(*map(pa.Array.to_pylist, b.columns), strict=True)]


def test_bucket_members_are_streamed(monkeypatch):
    monkeypatch.setattr(linkage, "ship", lambda _: None)
    monkeypatch.setattr(linkage, "materialize", lambda df, _: df)
    rng = np.random.default_rng(1)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        rows = np.stack([rng.integers(0, rng.integers(2, 40), n), rng.integers(0, rng.integers(1, 5), n)], 1)
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        want = {(k, r) for k, r in rows.tolist() if len(set(rows[rows[:, 0] == k, 1].tolist())) > 1}
        for step in (1, 2, 5, 100):
            assert set(linkage.bucket_members(Sorted(rows, step), "x")) == want


def test_blocks_are_met_pair_by_pair_and_by_matrices(monkeypatch):
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 50)).astype(np.uint64)) for _ in range(40)]
    ranges, values = np.cumsum([0] + [len(x) for x in sets]), np.concatenate(sets)
    plain = [set(x.tolist()) for x in sets]
    want = sorted((i, j) for i in range(15) for j in range(25) if plain[i] and plain[15 + j] and 100 * len(plain[i] & plain[15 + j]) >= 40 * len(plain[i] | plain[15 + j]))
    for pairs, width in ((0, 7), (0, 4096), (10**9, 7)):
        monkeypatch.setattr(linkage, "PAIRS", pairs)
        monkeypatch.setattr(linkage, "WIDTH", width)
        i, j = linkage._similar_across(values, ranges, np.arange(15), np.arange(15, 40), 40)
        assert sorted(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_groups_stay_whole():
    rng = np.random.default_rng(2)
    rows = sorted((int(a), int(b), n) for n, (a, b) in enumerate(rng.integers(0, 9, (500, 2))))
    table = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=list("abc"))
    for step in (1, 3, 50, 500):
        for limit in (1, 200, 10**6):
            got = list(linkage._groups((table.slice(k, step) for k in range(0, 500, step)), 2, limit))
            assert pa.Table.from_batches(got).to_pylist() == table.to_pylist()
            ends = [(g.column(0)[at].as_py(), g.column(1)[at].as_py()) for g in got for at in (0, -1)]
            assert all(a != b for a, b in zip(ends[1::2], ends[2::2], strict=False))
