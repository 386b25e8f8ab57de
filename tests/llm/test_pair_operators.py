"""Operators that compare rows with each other, against all pairs or all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from washline.llm import graph, neighbors, queries, repeats, simhash, urls, warc

from .conftest import TABLES, rows


# exact repeats

def plain_repeats(texts, length):
    seen = Counter(t[i: i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mask = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if seen[t[i: i + length]] > 1:
                mask[i: i + length] = True
        out.append(mask)
    return out


def test_interval_expansion_finds_every_repeat():
    rng = random.Random(1)
    for _ in range(150):
        length = rng.choice([1, 2, 3, 5, 8, 20])
        texts = [bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 8))]
        texts.append(texts[0][5:30] + texts[-1][:20] + b"z")
        for text, starts, mask in zip(texts, repeats.repeated_starts(texts, length), plain_repeats(texts, length)):
            own = np.zeros(len(text), bool)
            for i in starts:
                own[i: i + length] = True
            assert (own == mask).all()


def test_runs_cover_every_window_and_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(2)
    text = bytes(rng.choice(b"abcd ") for _ in range(5000))
    anchors, starts, many = repeats.runs(text, 100)
    covered = [i for s, n in zip(starts, many) for i in range(s, s + n)]
    assert sorted(set(covered)) == list(range(len(text) - 99))
    inside = text[1234:1600]
    own = set(repeats.runs(inside, 100)[0].tolist())
    assert own <= set(anchors.tolist())


@pytest.mark.parametrize("size", [999, 1000, 1001, 1900, 1901, 1902, 5000])
def test_runs_visit_every_window_once(monkeypatch, size):
    monkeypatch.setattr(repeats, "PIECE", 1000)
    rng = random.Random(size)
    _, starts, many = repeats.runs(bytes(rng.choice(b"abcd ") for _ in range(size)), 100)
    assert [i for s, n in zip(starts, many) for i in range(s, s + n)] == list(range(size - 99))


def check_repeats(df, length, crowd):
    found = rows(repeats.remove_repeats(df, length=length, crowd=crowd))
    texts = [(r["text"] or "").encode() for r in rows(df)]
    expected = Counter()
    for text, mask in zip(texts, plain_repeats(texts, length)):
        kept = bytes(np.frombuffer(text, np.uint8)[~mask]) if text else b""
        runs = int((np.diff(np.concatenate(([0], mask.astype(int)))) == 1).sum())
        expected[(len(text), kept, runs)] += 1
    assert Counter((r["n_bytes"], bytes(r["kept"]), len(r["spans"])) for r in found) == expected


def test_unique_text_of_several_pieces_is_kept(spark):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=2 * repeats.PIECE + 5000))
    df = spark.createDataFrame([(1, text), (2, text[5000:5100])], "doc_id long, text string")
    check_repeats(df, 60, 2048)
    found = {r["doc_id"]: r for r in rows(repeats.remove_repeats(df, length=60))}
    assert [(x["start"], x["end"]) for x in found[1]["spans"]] == [(5000, 5100)]


@pytest.mark.parametrize("crowd", [2048, 1])
def test_repeats_of_odd_rows(odd_documents, crowd):
    check_repeats(odd_documents.where("doc_id is null or doc_id <> 6"), 40, crowd)


def test_anchor_places_are_those_of_the_runs():
    rng = random.Random(9)
    text = bytes(rng.choice(b"abcd ") for _ in range(3000))
    for anchor, start, many in zip(*repeats.runs(text, 100)):
        context = text[start: start + many + 99]
        place = repeats.anchor_place(context, 100)
        piece = np.frombuffer(context[place: place + repeats.ANCHOR], np.uint8).astype(np.uint64)
        assert repeats._grams(piece, repeats.ANCHOR, repeats._powers(40))[0] == anchor
        assert place <= 100 - repeats.ANCHOR and place - (many - 1) >= 0


def test_thousands_of_near_copies_make_few_rows(spark, monkeypatch):
    """Copies with an edit each: the runs around an edit are halved, and not cut into single windows."""
    rng = random.Random(6)
    base = [rng.choice("abcdefgh ") for _ in range(700)]
    texts = []
    for i in range(300):
        own = list(base)
        for _ in range(2):
            own[rng.randrange(700)] = rng.choice("XYZ") + str(i)
        texts.append("".join(own))
    made = []
    halve = repeats._halves

    def counted(length):
        made.append(length)
        return halve(length)

    monkeypatch.setattr(repeats, "_halves", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_repeats(df, 120, 4)
    assert 1 <= len(made) <= 8
    one = repeats.NARROWED.names.index("row")
    context = texts[0][:219].encode()
    batch = next(halve(120)(iter([repeats._columns([(1, 0, 88, 1, 5, 0, None, context)], pa.schema([
        (n, repeats.NARROWED.field(n).type) for n in ("group", "low", "high", "n", "row", "start", "place", "context")
    ]))])))
    assert batch.num_rows <= 2 and set(batch.column(one).to_pylist()) == {5}


@pytest.mark.parametrize("crowd", [2048, 3])
def test_repeats_of_shared_passages(spark, crowd):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    make = lambda n: " ".join(word() for _ in range(n))
    passage, near = make(30), make(60)
    texts = [make(20) + " " + passage + " " + make(20) for _ in range(30)]
    texts += [near[:k] + "#" + near[k:] for k in range(20, 200, 9)] + ["ab" * 150, make(5)] + [texts[0]] * 2
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    check_repeats(df, 50, crowd)


def test_repeats_query(spark, documents):
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in rows(documents)}
    masks = dict(zip(texts, plain_repeats(list(texts.values()), 200)))
    for r in rows(queries.op6(spark, TABLES)):
        text, mask = texts[r["doc_id"]], masks[r["doc_id"]]
        kept = bytes(np.frombuffer(text, np.uint8)[~mask]) if text else b""
        assert (r["n_bytes"], r["n_removed"]) == (len(text), int(mask.sum()))
        assert r["kept_sha256"] == hashlib.sha256(kept).hexdigest()
    assert rows(repeats.remove_repeats(documents.limit(0))) == []


# SimHash

def plain_fingerprint(text, size=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i: i + size]) for i in range(len(words) - size + 1)]
    shingles = shingles or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest key reachable by links of two bits, for ``{key: fingerprint}``."""
    keys = sorted(prints)
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                low, high = sorted((find(a), find(b)))
                parent[high] = low
    return {k: find(k) for k in keys}


def test_golay_words_two_bits_apart_share_an_index():
    errors = simhash._error_table()
    assert len(np.unique(errors)) == 2048
    rng = np.random.default_rng(6)
    words = rng.integers(0, 1 << 23, 2000).astype(np.uint32)
    mine = simhash.codeword_indices(words, errors)
    assert set((mine >= 0).sum(axis=1).tolist()) == {1, 6}
    for flips in (1, 2):
        other = words.copy()
        for _ in range(flips):
            other ^= (1 << rng.integers(0, 23, 2000)).astype(np.uint32)
        theirs = simhash.codeword_indices(other, errors)
        assert all(set(a[a >= 0]) & set(b[b >= 0]) for a, b in zip(mine, theirs))


def test_simhash_query(spark, documents):
    prints = {r["doc_id"]: plain_fingerprint(r["text"]) for r in rows(documents)}
    wanted = plain_components(prints)
    found = rows(queries.op10(spark, TABLES))
    assert len(found) == len(prints)
    for r in found:
        assert r["fingerprint"] == f"{prints[r['doc_id']]:016x}"
        assert r["component_id"] == wanted[r["doc_id"]]


@pytest.mark.parametrize("bucket", [64, 2])
def test_links_connect_all_within_two_bits(spark, bucket):
    rng = random.Random(8)
    centers = [rng.getrandbits(64) for _ in range(4)]
    values = {0, (1 << 64) - 1, 1 << 63}
    for c in centers:
        for _ in range(60):
            v = c
            for _ in range(rng.randint(0, 4)):
                v ^= 1 << rng.randrange(64)
            values.add(v)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(signed(v),) for v in values], "fingerprint long")
    links = rows(simhash.links(df, bucket))
    assert all(((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 2 for r in links)
    wanted = plain_components({signed(v): v for v in values})
    found = {k: k for k in wanted}
    linked = spark.createDataFrame([(r["a"], r["b"]) for r in links], "a long, b long")
    found.update({r["node"]: r["root"] for r in rows(graph.components(linked))})
    assert found == wanted


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, None)]
    found = {r["node"]: r["root"] for r in rows(graph.components(spark.createDataFrame(edges, "a long, b long")))}
    assert found == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 160)}}
    assert rows(graph.components(spark.createDataFrame([], "a long, b long"))) == []


def test_one_of_each_group_stays(spark, odd_documents):
    for mark in (simhash.near_duplicates, simhash.similar):
        kept = simhash.keep_one(odd_documents, mark(odd_documents))
        assert kept.columns == odd_documents.columns
        # 1, 2 and 3 have no words; 4 comes twice; so does the text without a key
        assert sorted((r["doc_id"] or 0) for r in rows(kept)) == [0, 1, 4, 5, 6, 7, 8]
        nothing = odd_documents.limit(0)
        assert simhash.keep_one(nothing, mark(nothing)).count() == 0


def test_similar_texts_are_found_and_others_left_alone(spark):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    texts, groups = [], []
    for group in range(60):
        base = [word() for _ in range(rng.randint(60, 300))]
        for _ in range(rng.choice([1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randint(0, len(base) // 60)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            groups.append(group)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in rows(simhash.similar(df))}
    assert all(groups[i] == groups[c] for i, c in found.items())
    sets = [simhash.shingles(t.encode().split(), 5) for t in texts]
    pairs = [
        (i, j) for i in range(len(texts)) for j in range(i + 1, len(texts))
        if groups[i] == groups[j] and len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j])
    ]
    assert sum(found[i] == found[j] for i, j in pairs) >= 0.95 * len(pairs) and len(pairs) > 50
    assert {r["doc_id"]: r["component"] for r in rows(simhash.similar(df, bucket=2))} == found


def block_edits(rng):
    """Pairs of texts whose shingles are similar to 0.8 or more: a block added or cut, short texts too."""
    words = [f"w{i}" for i in range(3000)]
    text = lambda n: [words[min(int(rng.paretovariate(0.6)), 2999)] for _ in range(n)]
    pairs = []
    for n, share in [(300, 0.1), (300, 0.15), (200, 0.2), (14, 0.08), (20, 0.05), (10, 0.1), (8, 0.13)]:
        for i in range(30):
            base, more = text(n), text(int(n * share) or 1)
            pairs.append((base, [base + more, more + base, base[len(more):]][i % 3]))
    jaccard = lambda a, b: len(a & b) / len(a | b)
    sets = [[simhash.shingles([w.encode() for w in x], 5) for x in pair] for pair in pairs]
    return [
        (" ".join(a), " ".join(b)) for (a, b), pair in zip(pairs, sets) if 0.8 <= jaccard(*pair) < 1
    ]


def test_block_edits_and_short_texts_become_candidates(spark):
    pairs = block_edits(random.Random(14))
    assert len(pairs) > 120
    df = spark.createDataFrame(
        [(2 * i + j, pair[j]) for i, pair in enumerate(pairs) for j in (0, 1)], "doc_id long, text string"
    )
    prints = simhash.wide_prints(df, "doc_id", "text", 5)
    names = {r["doc_id"]: bytes(r["fingerprint"]) for r in rows(prints.select("doc_id", "fingerprint"))}
    links = {frozenset((bytes(r["a"]), bytes(r["b"]))) for r in rows(simhash.wide_links(prints, 256))}
    assert all(frozenset((names[2 * i], names[2 * i + 1])) in links for i in range(len(pairs)))


@pytest.mark.parametrize("bucket", [4096, 2])
def test_links_are_exact_at_the_similarity(spark, bucket):
    rng = random.Random(15)
    pairs = block_edits(rng)
    for i in range(120):  # scattered edits around 0.8
        base = [f"v{rng.randrange(4000)}" for _ in range(rng.choice([40, 100, 300]))]
        copy = list(base)
        for _ in range(max(1, int(len(base) * rng.choice([0.01, 0.02, 0.025, 0.03])))):
            copy[rng.randrange(len(copy))] = f"v{rng.randrange(4000)}"
        pairs.append((" ".join(base), " ".join(copy)))
    texts = [t for pair in pairs for t in pair] + [pairs[0][0], pairs[-1][1]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["component"] for r in rows(simhash.similar(df, bucket=bucket))}
    sets = [simhash.shingles(t.encode().split(), 5) for t in texts]
    least = list(range(len(texts)))
    below = 0
    for i in range(len(texts)):  # texts of other pairs share next to nothing
        for j in range(i):
            share = len(sets[i] & sets[j]) / len(sets[i] | sets[j])
            below += 0.7 < share < 0.8
            if share >= 0.8:
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = [new if x == old else x for x in least]
    assert found == dict(enumerate(least)) and below > 10


def test_forest_connects_what_is_near():
    rng = np.random.default_rng(13)
    base = rng.integers(0, 1 << 63, (6, 4), dtype=np.uint64)
    prints = np.concatenate([base[i % 6][None] ^ np.uint64(1 << (i % 61)) for i in range(80)])
    prints = prints[rng.permutation(80)]
    keys = np.repeat([3, 9, 12, 40], [1, 2, 30, 47])
    edges = {
        frozenset((r["a"], r["b"])) for batch in simhash._linked(keys, prints, 8) for r in batch.to_pylist()
    }
    start = 0
    for size in (1, 2, 30, 47):
        own = [p.tobytes() for p in prints[start: start + size]]
        near = {i: {j for j in range(size) if np.bitwise_count(
            prints[start + i] ^ prints[start + j]).sum() <= 8} for i in range(size)}
        place = {p: i for i, p in enumerate(own)}
        parent = list(range(size))

        def find(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for edge in edges:
            ends = [place[x] for x in edge if x in place]
            if len(ends) == 2:
                parent[find(ends[0])] = find(ends[1])
        assert all(find(i) == find(j) for i in near for j in near[i])
        start += size


# URLs

def plain_judge(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [
        (len(h) + len(p), len(h), h + p, a) for h, p, a in rules
        if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    best = max(fit, key=lambda f: (f[0], f[1], [-ord(c) for c in f[3]]), default=None)
    return host, path, best and best[2], best[3] if best else default


@pytest.mark.parametrize("per_range", [200_000, 5])
def test_rules_on_odd_urls(spark, per_range, monkeypatch):
    monkeypatch.setattr(urls, "HOSTS_PER_RANGE", per_range)
    rng = random.Random(9)
    labels = ["com", "net", "a", "b", "www", "x-y", "co", ""]
    rules = [
        (".".join(rng.choice(labels[:-1]) for _ in range(rng.randint(1, 4))), rng.choice(["/", "", "/en/", "/en/x"]),
         rng.choice(["allow", "block"])) for _ in range(25)
    ]
    every = [None, "", "no scheme", "http://", "http:///path", "HTTP://WWW.A.COM/en/?q#f", "http://a.com?x", "http://É.com/"]
    every += [
        "https://" + ".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) + rng.choice(["", "/", "/en/", "/en/xy#t", "?a/b"])
        for _ in range(300)
    ]
    table = spark.createDataFrame(
        [(i, u, "mine", "other") for i, u in enumerate(every)], "page_id long, url string, host string, key string"
    )
    given = spark.createDataFrame([*rules, rules[0], (None, "/", "block")], "host string, path string, action string")
    for r in rows(urls.judge(table, given)):
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == plain_judge(every[r["page_id"]], rules), every[r["page_id"]]
        assert r["key"] == "other"
    assert {r["verdict"] for r in rows(urls.judge(table, given.limit(0), default="block"))} == {"block"}
    assert rows(urls.judge(table.limit(0), given)) == []


def test_url_plan_has_no_python(spark):
    df = queries.op7(spark, TABLES)
    assert "Python" not in df._jdf.queryExecution().toString()


# WARC

def test_chunks_and_records_round_trip():
    rng = random.Random(10)
    for size in (0, 1, 4095, 4096, 4097, 100_000):
        payload = bytes(rng.randrange(256) for _ in range(size))
        assert warc.unchunked(warc.chunked(payload)) == payload
        parts = warc.page_records("7", "7/1", payload, None, None, segment=1000)
        back = list(warc.parse(b"".join(p + warc.END for p in parts)))
        assert b"".join(r.block for r in back).endswith(b"0\r\n\r\n")
        assert [r.kind for r in back] == ["response", *["continuation"] * (len(parts) - 1)]
    assert warc.unchunked(b"3;ext=1\r\nabc\r\n0\r\nTrailer: x\r\n\r\n") == b"abc"
    for broken in (b"", b"5\r\nabc\r\n0\r\n\r\n", b"zz\r\nabc\r\n"):
        with pytest.raises(warc.BrokenArchive):
            warc.unchunked(broken)
    with pytest.raises(warc.BrokenArchive):
        list(warc.parse(parts[0][:-1] + warc.END))


def test_archives_of_odd_pages(spark):
    big = "ü\r\n\r\nWARC/1.1\r\n" * 9000
    pages = [(1, None, "x"), (2, "", "x"), (3, "a", "x"), (3, "a", "x"), (4, "a", "x"), (5, big, "x"),
             (6, big, "x"), (None, "b", "x"), (None, "b", "x"), (9, "c", "x")]
    table = spark.createDataFrame(pages, "page_id long, html string, payload string")
    found = rows(warc.round_trip(table))
    assert len(found) == len(pages)
    by = lambda k: sorted((r["record_type"], r["refers_to"], r["payload_bytes"]) for r in found if r["page_id"] == k)
    assert by(1) == [("revisit", 2, 0)] and by(2) == [("response", None, 0)]
    assert by(3) == [("revisit", 4, 1)] * 2 and by(4) == [("response", None, 1)]
    assert by(6) == [("response", None, len(big.encode()))] and by(5) == [("revisit", 6, len(big.encode()))]
    assert sorted(r["record_type"] for r in found if r["page_id"] is None) == ["response", "revisit"]
    whole = next(r for r in found if r["page_id"] == 6)
    assert bytes(whole["payload"]) == big.encode()
    assert whole["payload_digest"] == warc.base32_digest(big.encode())
    assert rows(warc.round_trip(table.limit(0))) == []


def test_missing_segments_are_noticed(spark):
    payload = bytes(5000)
    parts = warc.page_records("7", "7/1", payload, None, None, segment=1000)
    kept = [warc._row(r) for r in warc.parse(b"".join(p + warc.END for p in parts[:2] + parts[3:]))]
    records = spark.createDataFrame(kept, warc.PARSED_SQL)
    with pytest.raises(Exception, match="missing"):
        warc.reassemble(records).collect()


# nearest neighbours

def exact_neighbours(ids, matrix, asks, k):
    out = {}
    for i in np.flatnonzero(asks):
        far = np.sqrt(((matrix - matrix[i]) ** 2).sum(axis=1))
        far[ids == ids[i]] = np.inf
        out[ids[i]] = [(int(ids[j]), far[j]) for j in np.lexsort((ids, far))[:k] if np.isfinite(far[j])]
    return out


def test_recall_on_the_whole_table(spark):
    table = rows(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"))
    ids = np.array([r["vec_id"] for r in table])
    matrix = np.array([r["embedding"] for r in table], dtype=np.float64)
    exact = exact_neighbours(ids, matrix, ids % 100 == 0, 10)
    found = {}
    for r in rows(queries.op3(spark, "/root/testdata/sf0.1")):
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q, answers in exact.items():
        got = sorted(found[q])
        assert [g[0] for g in got] == list(range(1, 11))
        assert [(g[2], g[1]) for g in got] == sorted((g[2], g[1]) for g in got)
        hits += len({g[1] for g in got} & {a for a, _ in answers})
        scores = dict(zip(ids.tolist(), np.sqrt(((matrix - matrix[ids == q][0]) ** 2).sum(axis=1))))
        assert all(abs(scores[g[1]] - g[2]) < 1e-9 for g in got)
    assert hits >= 0.9 * 10 * len(exact)


def test_odd_vectors_and_hot_copies(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(11)
    data = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    data += [(100 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(80)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 4, [None, 1.0, 1.0, 1.0], [nan, 1.0, 1.0, 1.0], [inf, 1.0, 1.0, 1.0], [1.0]]
    table = spark.createDataFrame(
        [(i, v, i) for i, v in data] + [(200 + i, v, 0) for i, v in enumerate(odd)] + [(None, [1.0] * 4, 0)],
        "vec_id long, embedding array<float>, list int",
    )
    found = rows(neighbors.nearest(table, F.col("vec_id") % 10 == 0, k=5, list_rows=20))
    ids = np.array([i for i, _ in data])
    matrix = np.array([np.float32(v) for _, v in data], dtype=np.float64)
    exact = exact_neighbours(ids, matrix, ids % 10 == 0, 5)
    assert {r["query_id"] for r in found} == set(exact)
    hits = sum((r["vec_id"] in {a for a, _ in exact[r["query_id"]]}) for r in found)
    assert hits >= 0.9 * 5 * len(exact)
    assert all(r["vec_id"] == 100 + r["rank"] for r in found if r["query_id"] == 100)
    few = rows(neighbors.nearest(table.where("vec_id < 3"), F.col("vec_id") >= 0, k=5))
    assert sorted(r["query_id"] for r in few) == [0, 0, 1, 1, 2, 2]
    assert rows(neighbors.nearest(table.limit(0), F.lit(True))) == []


def test_rows_that_repeat_an_id_are_candidates(spark):
    table = spark.createDataFrame(
        [(0, [0.0, 1.0]), (0, [0.0, 2.0]), (1, [0.0, 4.0]), (2, [0.0, 4.0]), (2, [0.0, 4.0])],
        "vec_id long, embedding array<float>",
    )
    found = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows(
        neighbors.nearest(table, F.col("vec_id") == 0, k=4)
    ))
    assert found == sorted(
        [(0, 1, 0, 1.0), (0, 2, 1, 3.0), (0, 3, 2, 3.0), (0, 4, 2, 3.0)]
        + [(0, 1, 0, 1.0), (0, 2, 1, 2.0), (0, 3, 2, 2.0), (0, 4, 2, 2.0)]
    )


def test_a_url_in_a_column_that_the_result_replaces(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, action string")
    for name in ("host", "path", "rule", "verdict"):
        table = spark.createDataFrame([(1, "http://a.example.com/en/x"), (2, None)], f"page_id long, {name} string")
        found = {r["page_id"]: (r["host"], r["path"], r["verdict"]) for r in rows(urls.judge(table, rules, url=name))}
        assert found == {1: ("a.example.com", "/en/x", "block"), 2: ("", "", "allow")}


def test_similar_texts_are_proposed_by_golay_keys(spark, monkeypatch):
    """Without any key of least hashes, fingerprints within two bits still bring texts together; what they
    propose is checked on the whole sets."""
    words = [f"word{i}" for i in range(900)]
    near = " ".join(words)
    texts = [near, near + " tail", "something else " * 3, " ".join(f"other{i}" for i in range(60))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    monkeypatch.setattr(simhash, "wide_links", lambda nodes, bits, bucket: spark.createDataFrame([], "a binary, b binary"))
    found = {r["doc_id"]: r["component"] for r in rows(simhash.similar(df))}
    assert found == {0: 0, 1: 0, 2: 2, 3: 3}
    assert {r["doc_id"]: r["component"] for r in rows(simhash.similar(df, similarity=0.9999))} == {i: i for i in range(4)}
