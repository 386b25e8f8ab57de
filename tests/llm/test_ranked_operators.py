"""Outliers, ranked search and hard negatives against plain versions of themselves."""

import math
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from washline.llm import negatives, outliers, queries, search

from .conftest import TABLES, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BROKEN = "cast(X'61FF6220C3' as string)"


# quality

def plain_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(*[words[i:] for i in range(5)]))
    covered = {
        j for i in range(len(words) - 4) if windows[tuple(words[i: i + 5])] > 1 for j in range(i, i + 5)
    }
    seen, again, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            again += line in seen
            seen.add(line)
    many = lambda kept: sum(c in kept for c in text)
    return (
        len(words), sum(map(len, words)), many("#*$%&|<>"), lines, again, len(covered), many(".,;:!?"),
        many("ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    )


def plain_distances(vectors):
    """Distances of one group's vectors by the definition: medians, starts, shells, steps, last estimates."""
    size = outliers.SIZE

    def middle(values):
        steps = sorted(math.floor(v / outliers.MEDIAN_STEP + 0.5) for v in values)
        return steps[(len(steps) + 1) // 2 - 1] * outliers.MEDIAN_STEP

    center = np.array([middle(c) for c in vectors.T])
    spread = np.array([middle(c) for c in np.abs(vectors - center).T])
    z = (vectors - center) / np.maximum(1.4826 * spread, [s for _, s in outliers.VECTOR])

    def estimate(part, factor):
        cov = np.cov(part.T, bias=True)
        if factor is None:
            scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            cov = cov / np.outer(scale, scale)
        else:
            cov = cov * factor
        np.fill_diagonal(cov, np.maximum(np.diag(cov), 1))
        values, axes = np.linalg.eigh(cov)
        values = np.maximum(values, outliers.LEAST_VARIANCE)
        return part.mean(axis=0), axes @ np.diag(1 / values) @ axes.T, np.log(values).sum()

    def far(mean, inverse):
        return np.einsum("ni,ij,nj->n", z - mean, inverse, z - mean)

    length = np.linalg.norm(z, axis=1)
    starts = [z * 0, np.tanh(z), np.divide(z, length[:, None], out=z * 0, where=length[:, None] > 0)]
    params = [(np.zeros(size), *estimate(s, None)[1:]) for s in starts]
    total = None
    for _ in range(outliers.STEPS):
        after = []
        for mean, inverse, _ in params:
            shell = np.floor(outliers.SHELLS * np.log2(np.maximum(far(mean, inverse), 1e-9)))
            rank = np.sort(shell)[(len(z) + size + 2) // 2 - 1]
            after.append(estimate(z[shell <= rank], outliers.consistency(0.5)))
        params, before, total = after, total, sum(p[2] for p in after)
        if before is not None and abs(before - total) < outliers.SETTLED:
            break
    mean, inverse, _ = min(params, key=lambda p: p[2])
    inner = z[far(mean, inverse) <= outliers.chi2_at(outliers.INNER, size)]
    mean, inverse, _ = estimate(inner, outliers.consistency(outliers.INNER))
    return np.sqrt(far(mean, inverse))


def plain_vector(r):
    words, chars = r["n_words"], r["word_chars"]
    return [
        math.log((chars + 100) / (words + 20)), math.asinh(100 * r["n_symbols"] / (chars + 100)),
        r["n_dup_lines"] / (r["n_lines"] + 5), r["n_repeat_words"] / (words + 20),
        math.sqrt((r["n_marks"] + 3) / (words + 20)), math.sqrt((r["n_capitals"] + 3) / (chars + 100)),
    ]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from("ab \n\t.%Aé漢\x0b\x85\xa0"), max_size=120))
def test_counts_of_a_text(text):
    assert outliers.count(text.encode()) == plain_counts(text)


def test_counts_of_long_texts(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(5000)) + "\nsame line\n" * 40
    whole = outliers.count(text.encode())
    monkeypatch.setattr(outliers, "PIECE", 64)
    assert outliers.count(text.encode()) == whole == plain_counts(text)


def test_chi_square_values():
    for share, dims, value in [(0.5, 2, 1.3863), (0.975, 6, 14.4494), (0.99, 1, 6.6349), (0.999, 10, 29.5883)]:
        assert abs(outliers.chi2_at(share, dims) - value) < 1e-3
    assert abs(outliers.consistency(1 - 1e-12) - 1) < 1e-6


def test_quality_query(spark, documents):
    found = {r["doc_id"]: r for r in rows(queries.op11(spark, TABLES))}
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
    texts = {r["doc_id"]: r for r in rows(documents)}
    assert set(found) == set(texts)
    for i, d in texts.items():
        own = dict(zip(names, plain_counts(d["text"])))
        assert all(found[i][n] == own[n] for n in names if n in found[i])
        failed = own["n_words"] < 10 or 100 * own["n_repeat_words"] > 20 * own["n_words"]
        assert found[i]["base_failed"] == failed
        assert not (failed and found[i]["kept"])


def test_outliers_of_groups_and_pools(spark, documents):
    """One group of its own, two that are pooled by language, and a rest too small for estimates."""
    docs = rows(documents)
    made = []
    for n, d in enumerate(docs):
        lang, source = ("en", "a") if n % 2 else ("de", f"s{n % 3}") if n % 20 else ("fr", None)
        made.append((n, d["text"], lang, source))
    table = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    found = rows(outliers.judge(table, least=50))
    groups = {}
    for r in found:
        if not r["base_failed"]:
            groups.setdefault(r["lang"], []).append(r)
    limit = math.sqrt(outliers.chi2_at(outliers.OUTER, outliers.SIZE))
    for lang, own in groups.items():
        if lang == "fr":
            assert all(r["distance"] is None and r["kept"] for r in own)
            continue
        far = plain_distances(np.array([plain_vector(r) for r in own]))
        assert np.allclose([r["distance"] for r in own], far, rtol=1e-6, atol=1e-6)
        assert [r["kept"] for r in own] == [x <= limit for x in far]


def test_planted_outliers_do_not_hide_each_other(spark):
    """A quarter of the texts are alike and far off: plain means and covariances would take them in."""
    rng = np.random.default_rng(5)
    good = [" ".join(rng.choice(["river", "stone", "a", "of", "mountain", "it", "walked"], 60 + i % 90)) + "." for i in range(300)]
    bad = [" ".join(f"x{j}%%#$" for j in range(40 + i % 30)) for i in range(100)]
    table = spark.createDataFrame(
        [(i, t, "en", "s") for i, t in enumerate(good + bad)], "doc_id long, text string, lang string, source string"
    )
    kept = {r["doc_id"] for r in rows(outliers.judge(table)) if r["kept"]}
    assert not kept & set(range(300, 400))
    passing = {i for i, t in enumerate(good) if 100 * plain_counts(t)[5] <= 20 * plain_counts(t)[0]}
    assert len(kept & passing) >= 0.99 * len(passing)


def test_quality_of_odd_rows(spark, odd_documents):
    found = rows(outliers.judge(odd_documents, least=4))
    assert len(found) == odd_documents.count()
    assert [(r["n_words"], r["kept"]) for r in found if r["doc_id"] in (1, 2, 3)] == [(0, False)] * 3
    copies = [tuple(r.values()) for r in found if r["doc_id"] == 4]
    assert len(copies) == 2 and copies[0] == copies[1]
    assert rows(outliers.judge(odd_documents.limit(0))) == []
    broken = spark.range(1).selectExpr("id AS doc_id", f"{BROKEN} AS text", "'x' AS lang", "'y' AS source")
    assert [(r["n_words"], r["word_chars"]) for r in rows(outliers.judge(broken))] == [(2, 4)]


# search

def plain_search(docs, items, k=10):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    own = [(i, Counter(pattern.findall((t or "").translate(LOWER)))) for i, t in docs]
    own = [(i, c) for i, c in own if c]
    many, total = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        asked = Counter(pattern.findall((text or "").translate(LOWER)))
        scores = []
        for i, c in own:
            m = 100 - 75 + (75 * sum(c.values()) * many) // total
            score = sum(
                n * math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t, n in asked.items() if t in c
            )
            if score > 0:
                scores.append((-score, i is not None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def answers(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in rows(df)), key=repr)


def test_search_query(spark, documents):
    docs = [(r["doc_id"], r["text"]) for r in rows(documents)]
    items = [(r["item_id"], r["text"]) for r in rows(spark.read.parquet(f"{TABLES}/benchmark.parquet"))]
    assert answers(queries.op12(spark, TABLES)) == plain_search(docs, items)


def test_search_in_shards_chunks_and_small_blocks(spark, documents, monkeypatch):
    monkeypatch.setattr(search, "SHARD_BYTES", 4096)
    monkeypatch.setattr(search, "BROADCAST_BYTES", 0)
    docs = [(r["doc_id"], r["text"]) for r in rows(documents.limit(60))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    items = [(i, t[: 60 + i]) for i, t in docs[:12]] + [(90, None), (91, "zzzz"), (None, docs[5][1][:80])]
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert answers(search.search(table, asked, probes=1)) == plain_search(docs, items)


def test_bounds_are_never_below_scores(monkeypatch):
    monkeypatch.setattr(search, "CHUNK_TERMS", 7)
    monkeypatch.setattr(search, "KEY_BITS", 3)  # many false hits
    rng = np.random.default_rng(3)
    words = [f"t{i}".encode() for i in range(60)]
    texts = [b" ".join(rng.choice(words, rng.integers(1, 90), p=np.arange(60, 0, -1) / 1830)) for _ in range(150)]
    made = []
    import pyarrow as pa
    batch = pa.RecordBatch.from_arrays([pa.array(range(150)), pa.array(texts, pa.binary())], ["key", "text"])
    for out in search._scan(pa.int64())(iter([batch])):
        made += out.to_pylist()
    items = [search.Item(sorted(set(rng.choice(words, 9))), None) for _ in range(8)]
    for x in items:
        x.weights = rng.integers(0, 9000, len(x.terms)).astype(float)
    total = sum(len(t.split()) for t in texts)
    seen, held = 0, Counter()
    for block in (m for m in made if m["ids"] is not None):
        parts = search.length_part(np.array(block["lengths"]), 150, total)
        for item, bound in search.Bounds(items).of(block["width"], block["slices"], parts):
            for i, key in enumerate(block["ids"]):
                often = Counter(texts[key].split())
                exact = sum(int(w) * search.share(often[t], int(parts[i])) for t, w in
                            zip(items[item].terms, items[item].weights) if t in often)
                assert bound[i] >= exact
                seen += 1
    for m in made:
        held.update(dict(zip(m["terms"] or [], m["counts"] or [])))
    assert seen == 150 * 8
    assert held == Counter(t for x in texts for t in set(x.split()))


def test_search_of_odd_rows(spark, odd_documents):
    items = [(1, "the QUICK brown fox"), (1, "über word5"), (2, None), (None, "key 漢字"), (3, ""), (3, "text"), (3, "text")]
    asked = spark.createDataFrame([(*r, 7) for r in items], "item_id long, text string, score int")
    docs = [(r["doc_id"], r["text"]) for r in rows(odd_documents)]
    assert answers(search.search(odd_documents, asked)) == plain_search(docs, list(dict.fromkeys(items)))
    assert answers(search.search(odd_documents.limit(0), asked)) == []
    assert answers(search.search(odd_documents, asked.limit(0))) == []
    broken = spark.range(1).selectExpr("id AS doc_id", f"{BROKEN} AS text")
    assert [r["doc_id"] for r in rows(search.search(broken, spark.sql(f"SELECT 1 AS item_id, {BROKEN} AS text")))] == [0]


# hard negatives

def plain_mine(vectors, is_anchor, positives=5, count=3, low=50, high=95):
    own = [
        (n, i, label, [math.floor(256 * x) for x in v]) for n, (i, v, label) in enumerate(vectors)
        if i is not None and label is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for n, i, label, v in own:
        if not is_anchor(i):
            continue
        scored = sorted(
            (-sum(a * b for a, b in zip(v, w)), j, m, other == label)
            for m, j, other, w in own if m != n and len(w) == len(v)
        )
        for s, j, _, _ in [x for x in scored if x[3]][:positives]:
            fit = [x for x in scored if not x[3] and low * -s <= 100 * -x[0] <= high * -s]
            out += [(i, j, r, x[1], -s, -x[0]) for r, x in enumerate(fit[:count], 1)]
    return Counter(out)


def mined(df):
    return Counter(
        (r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"])
        for r in rows(df)
    )


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK_ROWS", 64)


def test_negatives_query(spark, small_blocks):
    vectors = [
        (r["vec_id"], r["embedding"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"])
        for r in rows(spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet"))
    ]
    assert mined(queries.op13(spark, "/root/testdata/sf0.01")) == plain_mine(vectors, lambda i: i % 50 == 0)


def test_negatives_with_ties_copies_and_overlapping_windows(spark, small_blocks):
    rng = np.random.default_rng(1)
    vectors = [
        (int(rng.integers(0, 400)), [float(x) for x in rng.integers(-2, 7, 3) / 8], int(rng.integers(0, 3)))
        for _ in range(300)
    ] + [(5000 + i, [0.5, 0.5, 0.25], i % 3) for i in range(150)]
    table = spark.createDataFrame(vectors, "vec_id long, embedding array<float>, label int")
    for low, high in [(50, 95), (0, 100), (90, 99)]:
        found = mined(negatives.mine(table, F.col("vec_id") % 3 == 0, low=low, high=high))
        assert found == plain_mine(vectors, lambda i: i % 3 == 0, low=low, high=high)
        assert found


def test_negatives_of_odd_rows(spark):
    big = 2.0 ** 22
    vectors = [
        (0, [1.0, 0.5], 1), (1, [1.0, 0.5], 1), (2, [0.75, 0.5], 2), (3, None, 1), (4, [1.0, None], 2),
        (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2), (7, [0.75, 0.5], None), (None, [0.75, 0.5], 2),
        (8, [], 1), (9, [], 1), (10, [], 2), (11, [1.0], 1), (2, [0.75, 0.5], 2),
        (12, [big, 1.0, 2.0], 1), (13, [big, 3.0, 1.0], 1), (14, [big * 0.75, 1.0, 0.5], 3),
    ]
    table = spark.createDataFrame([(*v, 1, 2) for v in vectors], "vec_id long, embedding array<double>, label int, row int, score int")
    found = mined(negatives.mine(table, F.col("vec_id") >= 0))
    assert found == plain_mine(vectors, lambda i: i >= 0)
    assert {x[0] for x in found} == {0, 1, 8, 9, 12, 13}
    assert mined(negatives.mine(table.limit(0), F.col("vec_id") >= 0)) == Counter()
    exact = negatives.products(np.array([[2.0 ** 40, 3.0]]), np.array([[2.0 ** 20, 1.0], [-(2.0 ** 40), 0.0]]))
    assert exact.tolist() == [[2 ** 60 + 3, -(2 ** 63)]]
