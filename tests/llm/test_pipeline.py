"""The pipeline against its stages' plain versions on the smallest tables."""

import corpus_pipeline
from washline.llm import decontaminate, language, lines, simhash

from .conftest import TABLES, rows
from .test_text_operators import LIBRARY


def plain_similar(texts):
    """Smallest key reachable by links of a five-word similarity of 0.8 or more."""
    sets = {i: simhash.shingles(t.encode().lower().split(), 5) for i, t in texts.items()}
    least = {i: i for i in sets}
    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and least[i] != least[j] and len(a & b) >= 0.8 * len(a | b):
                old, new = max(least[i], least[j]), min(least[i], least[j])
                least = {k: new if x == old else x for k, x in least.items()}
    return least


def test_pipeline_is_its_stages_one_after_another(spark, documents):
    docs = {r["doc_id"]: r for r in rows(documents)}
    ready = language.compressors(language.learn(documents))
    told = {
        i: d for i, d in docs.items() if any(c.isalpha() for c in d["text"] or "")
        and language.classify(language.lowered(d["text"]), ready)[1] >= language.MARGIN
    }
    sites = {}
    for source, text in {(d["source"], d["text"]) for d in told.values()}:  # copies are one page
        site = sites.setdefault(source, [0, {}])
        site[0] += 1
        for line in {x.strip(" ") for x in text.split("\n")} - {""}:
            site[1][line] = site[1].get(line, 0) + 1
    texts = {}
    for i, d in told.items():
        total, counts = sites[d["source"]]
        bad = {x for x, n in counts.items() if n >= lines.PAGES and n > lines.RATIO * total}
        texts[i] = "\n".join(x for x in d["text"].split("\n") if x.strip(" ") not in bad)
    worded = {i: t for i, t in texts.items() if t.split()}
    roots = {i: i for i in texts} | plain_similar(worded)
    single = {i: t for i, t in texts.items() if roots[i] == i}
    items = [(r["item_id"], decontaminate.normal(r["text"].encode())) for r in rows(
        spark.read.parquet(f"{TABLES}/benchmark.parquet")
    )]
    index = decontaminate.Index([p for p in items if len(p[1]) >= decontaminate.LEAST], decontaminate.EDITS)
    clean = {
        i: t for i, t in single.items()
        if not decontaminate.occurrences(decontaminate.normal(t.encode()), index)
    }
    found = rows(corpus_pipeline.run(spark, TABLES))
    assert {r["doc_id"]: r["n_tokens"] for r in found} == {
        i: len(LIBRARY.encode_ordinary(t)) for i, t in clean.items()
    }
    assert len(found) < len(docs)


def test_near_duplicates_are_those_of_the_sets(documents):
    texts = {r["doc_id"]: r["text"] or "" for r in rows(documents)}
    assert {r["doc_id"]: r["component"] for r in rows(simhash.similar(documents))} == plain_similar(texts)


def test_stages_keep_the_columns_and_odd_rows_do_no_harm(spark, odd_documents):
    docs = odd_documents
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, TABLES)
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        assert stage(spark, docs.limit(0), TABLES).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, TABLES).count() == docs.count()
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "language_id", "line_dedup", "simhash_near_dedup", "benchmark_decontamination", "byte_bpe",
    ]


def test_copies_of_a_page_do_not_make_it_boilerplate(spark):
    clean = [f"first line of {g}\nsecond line {g} goes on\nthird line ends {g}" for g in ("this page", "another")]
    texts = [("a", clean[0])] * 8 + [("b", clean[1])] * 6
    texts += [(s, f"menu of the site\nown words {i} of {s}") for s in "ab" for i in range(12)]
    texts += [("a", "menu of the site"), ("b", " menu of the site ")]
    df = spark.createDataFrame([(i, t, s) for i, (s, t) in enumerate(texts)], "doc_id long, text string, source string")
    out = corpus_pipeline.boilerplate(spark, df, TABLES)
    kept = corpus_pipeline.near_duplicates(spark, out, TABLES)
    found = {r["doc_id"]: r["text"] for r in rows(kept)}
    assert found[0] == clean[0] and found[8] == clean[1] and not set(found) & {1, 7, 9, 13}
    assert all(found[i] == texts[i][1].split("\n")[1] for i in range(14, 38))
    assert found[38] == found[39] == ""
