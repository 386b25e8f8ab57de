"""Operators on single texts against plain versions of themselves."""

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from washline.llm import bpe, decontaminate, language, licenses, lines, queries

from .conftest import TABLES, rows

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
LIBRARY = tiktoken.Encoding(
    "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.parse_ranks(RANKS), special_tokens={}
)


# licenses

def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = []
    for phrase, label in licenses.BASE.items():
        parts = phrase.split()
        found += [(i, label) for i in range(len(words)) if words[i: i + len(parts)] == parts]
    return len(words), sorted(found)


def test_license_query(spark, documents):
    found = {r["doc_id"]: r for r in rows(queries.op1(spark, TABLES))}
    texts = rows(documents.select("doc_id", "text"))
    assert len(found) == len(texts)
    for d in texts:
        r, (n, base) = found[d["doc_id"]], plain_base(d["text"])
        starts = [s for s, _ in base]
        assert (r["n_words"], r["n_base"]) == (n, len(base))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in base}))
        assert {x for _, x in base} <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1


def test_license_rules_have_what_they_need():
    assert len(licenses.rules()) > 300
    samples = {
        "Released under the MIT License.": "mit",
        "SPDX-License-Identifier: Apache-2.0": "apache-2",
        "licensed under the GNU General Public License, version 3": "gpl-3",
        "see https://creativecommons.org/licenses/by-sa/4.0/": "cc-by-sa-4",
        "Redistribution and use in source and binary forms, with or without modification, are permitted": "bsd",
        "Mozilla Public License, v. 2.0": "mpl-2",
    }
    for text, label in samples.items():
        joined = b" ".join(w for w in licenses.words(text.encode()) if w)
        assert label in {d.label for d in licenses.scan(joined)[0]}, text
    for rule in licenses.rules():
        assert rule.keyword == rule.keyword.lower()


NAMES = {
    "apache-2": "Apache License, Version 2.0", "bsd-2": "2-clause BSD license", "bsd-3": "New BSD license",
    "gpl-2": "GNU General Public License version 2", "gpl-3": "GNU General Public License, version 3",
    "lgpl-2.1": "GNU Lesser General Public License v 2.1", "lgpl-3": "GNU Lesser General Public License, version 3",
    "agpl-3": "GNU Affero General Public License version 3", "mpl-2": "Mozilla Public License, v. 2.0",
    "epl-2": "Eclipse Public License 2.0", "cddl-1": "Common Development and Distribution License 1.0",
    "bsl-1": "Boost Software License 1.0", "isc": "ISC license", "zlib": "zlib license", "artistic-2": "Artistic License 2.0",
    "ms-pl": "Microsoft Public License", "postgresql": "PostgreSQL license", "ofl-1.1": "SIL Open Font License 1.1",
    "cc-by-4": "Creative Commons Attribution License 4.0", "mulan-2": "Mulan Permissive Software License, version 2",
    "eupl-1.2": "European Union Public License 1.2", "upl-1": "Universal Permissive License", "icu": "ICU license",
    "osl-3": "Open Software License 3.0", "ncsa": "University of Illinois/NCSA Open Source License",
}
FORMS = ["See the {} for more.", "This work is released under the {} since 2019", "Licensed under the terms of the {}."]
TAGS = {
    "MIT OR Apache-2.0": {"mit-expat", "apache-2"}, "(MIT AND BSD-3-Clause) OR GPL-2.0-only": {"mit-expat", "bsd-3", "gpl-2"},
    "GPL-2.0-or-later WITH Classpath-exception-2.0 OR MPL-2.0": {"gpl-2", "mpl-2"}, "ISC": {"isc"},
    "LGPL-2.1-only OR MPL-1.1 OR EPL-2.0": {"lgpl-2.1", "mpl-1.1", "epl-2"},
}
SHORT = {
    "released under the GNU GPL version 2": "gpl-2", "under GPLv3": "gpl-3", "GPL v2 code": "gpl-2", "uses the GPL": "gpl",
    "GNU LGPL 2.1 library": "lgpl-2.1", "LGPL v3": "lgpl-3", "an LGPL library": "lgpl", "AGPL version 3": "agpl-3",
    "new BSD licence": "bsd-3", "the ISC licence": "isc",
}


def test_sentences_with_known_licenses():
    cases = [(form.format(spelled), {label}) for label, name in NAMES.items() for form in FORMS
             for spelled in {name, re.sub("(?i)license", lambda m: m[0][:5] + "ce", name)}]
    cases += [(f"// SPDX-License-Identifier: {tag}", labels) for tag, labels in TAGS.items()]
    cases += [(text, {label}) for text, label in SHORT.items()]
    assert len(cases) > 150
    for text, labels in cases:
        joined = b" ".join(w for w in licenses.words(text.encode()) if w)
        found = {d.label for d in licenses.scan(joined)[0]}
        assert labels <= found, (text, found)
        assert found <= labels | {"unknown-license", "apache", "mit", "gpl"}, (text, found)
        if text in SHORT:
            assert found == labels, (text, found)


def test_license_keyword_is_in_every_match():
    for rule in licenses.rules():
        text = rule.keyword
        assert licenses.scan(text.encode()) is not None


def samples_of(tree):
    """Texts that an expression matches: every branch, with and without every optional part."""
    out = [""]
    for kind, value in tree:
        name = str(kind)
        if name == "LITERAL":
            own = [chr(value)]
        elif name == "IN" and str(value[0][0]) != "NEGATE":
            own = [
                "7" if str(k) == "CATEGORY" else chr(v[0] if str(k) == "RANGE" else v) for k, v in value
            ]
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            once = samples_of(value[2])
            own = [x * n for n in {value[0], min(value[0] + 1, value[1])} for x in once]
        elif name == "SUBPATTERN":
            own = samples_of(value[-1])
        elif name == "BRANCH":
            own = [x for branch in value[1] for x in samples_of(branch)]
        else:
            own = [""] if name.startswith("ASSERT") else ["x"]
        out = [a + b for a in out for b in dict.fromkeys(own)]
    return out


def test_keywords_only_save_time(monkeypatch):
    texts = []
    for rule in licenses.rules():
        own = samples_of(re._parser.parse(rule.pattern.pattern.decode()))
        for text in own:
            assert rule.pattern.fullmatch(text.encode())
            assert any(word in text for word in rule.keywords), (rule.label, text)
        texts += [own[i].encode() for i in {0, len(own) // 3, len(own) // 2, len(own) - 1}]
    gated = [licenses.scan(text) for text in texts]

    class Open:
        def iter(self, text):
            return [(0, word) for rule in licenses.rules() for word in rule.keywords]

    monkeypatch.setattr(licenses, "_keywords", Open)
    assert [licenses.scan(text) for text in texts] == gated
    two = b"this work is attribution share alike and attribution non commercial"
    assert {d.label for d in licenses.scan(two)[0]} == {"cc-by-sa", "cc-by-nc"}


def test_suppression_is_containment_in_a_stronger_interval():
    rng = random.Random(3)
    strength = lambda d: (-d.priority, d.start - d.end, d.rule, d.start)
    for _ in range(2000):
        found = []
        for rule in range(rng.randint(0, 12)):
            start = rng.randint(0, 12)
            found.append(licenses.Detection("x", rng.choice([10, 20, 30]), rule, start, start + rng.randint(1, 6)))
        plain = [d for d in found if not any(
            o is not d and o.start <= d.start and o.end >= d.end and strength(o) < strength(d) for o in found
        )]
        assert licenses.suppress(found) == sorted(plain, key=lambda d: (d.start, d.end, d.rule))


def test_licenses_of_odd_rows(odd_documents):
    found = rows(licenses.find_licenses(odd_documents))
    assert len(found) == odd_documents.count()
    assert [r["n_words"] for r in found if r["doc_id"] == 1] == [0]
    assert rows(licenses.find_licenses(odd_documents.limit(0))) == []


# byte-level BPE

@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(
    alphabet=st.one_of(st.sampled_from(list("'stmdrevl  \n\t!1aZ 　é漢😀\x1c\x00")), st.characters(exclude_categories=["Cs"])),
    max_size=30,
), min_size=1, max_size=5))
def test_bpe_is_the_librarys(texts):
    encoder = bpe._encoder(RANKS)
    data = [t.encode() for t in texts]
    got = [encoder.ids(t, ends).tolist() for t, ends in zip(data, bpe.split(data))]
    assert got == [LIBRARY.encode_ordinary(t) for t in texts]


def test_long_slices_and_chunks():
    text = "ab" * 50_000 + " " + "x y  z\n" * 60_000 + "'s" * 1000
    parts = bpe.chunks(text.encode() * 4)
    assert b"".join(parts) == text.encode() * 4 and len(parts) > 1
    encoder = bpe._encoder(RANKS)
    got = [i for p in parts for e in bpe.split([p]) for i in encoder.ids(p, e).tolist()]
    assert got == LIBRARY.encode_ordinary(text * 4)


def test_bpe_query(spark, documents):
    found = {r["doc_id"]: r for r in rows(queries.op4(spark, TABLES))}
    for d in rows(documents.select("doc_id", "text")):
        ids = np.array(LIBRARY.encode_ordinary(d["text"] or ""), "<u4")
        r = found.pop(d["doc_id"])
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest())
        assert r["decoded_sha256"] == hashlib.sha256((d["text"] or "").encode()).hexdigest()
    assert not found


def test_bpe_of_odd_rows(odd_documents):
    tokens = bpe.encode(odd_documents, RANKS)
    back = rows(bpe.decode(tokens, RANKS))
    texts = [(r["text"] or "").encode() for r in rows(odd_documents)]
    assert [bytes(r["decoded"]) for r in back] == texts
    for r, text in zip(rows(tokens), texts):
        assert (r["ends"][-1] if r["ends"] else 0) == len(text)
    assert rows(bpe.encode(odd_documents.limit(0), RANKS)) == []
    wrong = tokens.withColumn("ends", tokens["ids"])
    with pytest.raises(Exception, match="do not end"):
        bpe.decode(wrong, RANKS).collect()


def test_ranks_are_read_whole():
    assert len(bpe.parse_ranks(RANKS)) == 50_256
    assert all(base64.b64encode(t) for t in list(bpe.parse_ranks(RANKS))[:10])


# decontamination

def plain_edits(passage, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(passage, 1):
        new = [i]
        for j, b in enumerate(text, 1):
            new.append(min(row[j - 1] + (a != b), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_passages_are_found_exactly_within_their_budget():
    rng = random.Random(5)
    words = ["the", "of", "and", "ting", "reat", "ion", "ent", "her", "wash", "line"]
    make = lambda n: " ".join(rng.choice(words) + rng.choice(words) for _ in range(n))
    passages = [(i, decontaminate.normal(make(rng.randint(4, 30)).encode())) for i in range(12)]
    index = decontaminate.Index(passages, 0.05)
    for _ in range(150):
        number = rng.randrange(len(passages))
        body = bytearray(passages[number][1])
        for _ in range(rng.randint(0, int(index.edits[number]) + 2)):
            at = rng.randrange(len(body))
            kind = rng.randrange(3)
            if kind == 0:
                body[at] = 122
            elif kind == 1:
                del body[at]
            else:
                body.insert(at, 122)
        text = (make(rng.randint(0, 20)) + " ").encode() + bytes(body) + (" " + make(rng.randint(0, 20))).encode()
        found = {}
        for i, start, end, edits in decontaminate.occurrences(text, index):
            assert plain_edits(index.texts[i], text[start:end]) <= edits
            found[i] = min(edits, found.get(i, 99))
        plain = {i: plain_edits(p, text) for i, p in enumerate(index.texts)}
        assert found == {i: e for i, e in plain.items() if e <= index.edits[i]}


def fewest_edits(passage, text):
    """``plain_edits``, a row at a time."""
    source, places = np.frombuffer(text, np.uint8), np.arange(len(text) + 1)
    row = np.zeros(len(text) + 1, dtype=np.int64)
    for i, symbol in enumerate(passage, 1):
        new = np.append(i, np.minimum(row[:-1] + (source != symbol), row[1:] + 1))
        row = np.minimum.accumulate(new - places) + places
    return int(row.min())


def test_decontamination_query(spark, documents):
    """Exactly the documents within a passage's budget, by the edit distance of every pair."""
    found = {r["doc_id"]: set(r["item_ids"].split(",")) for r in rows(queries.op5(spark, TABLES))}
    items = [(i["item_id"], decontaminate.normal(i["text"].encode())) for i in rows(spark.read.parquet(f"{TABLES}/benchmark.parquet"))]
    assert found
    for d in rows(documents.select("doc_id", "text")):
        text = decontaminate.normal((d["text"] or "").encode())
        near = {
            str(i) for i, p in items
            if p in text or fewest_edits(p, text) <= decontaminate.budget(len(p), decontaminate.EDITS)
        }
        assert near == found.get(d["doc_id"], set())


def test_recall_of_edited_words():
    """Passages of 60 to 400 bytes with words replaced or left out, in other text."""
    rng = random.Random(8)
    parts = ["the", "of", "stone", "river", "her", "wash", "line", "walk", "ed", "mount", "is", "a", "ing", "re"]
    words = [a + b for a in parts for b in parts]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n)).encode()
    passages = [(i, make(rng.randint(9, 50))) for i in range(40)]
    passages = [(i, p) for i, p in passages if 60 <= len(p) <= 400]
    index = decontaminate.Index(passages, decontaminate.EDITS)
    share = {}
    for many in (1, 2):
        hits = total = 0
        for number, (_, passage) in enumerate(passages):
            for _ in range(5):
                own = passage.split()
                for at in rng.sample(range(len(own)), many):
                    own[at] = rng.choice([b"", b"otherly", rng.choice(words).encode()])
                text = make(20) + b" " + b" ".join(w for w in own if w) + b" " + make(20)
                hits += number in {f[0] for f in decontaminate.occurrences(text, index)}
                total += 1
        share[many] = hits / total
    assert share[1] >= 0.95 and share[2] >= 0.7, share


def test_decontamination_of_odd_rows_and_in_shards(spark, odd_documents, monkeypatch):
    items = spark.createDataFrame(
        [(1, "THE quick  brown fox jumps over\nthe lazy dog while the cat sleeps"), (2, None), (3, ""),
         (4, "short"), (None, "a text without a key, as long as it may be"), (1, "a text without a key. no more")],
        "item_id long, text string",
    )
    found = rows(decontaminate.contaminated(odd_documents, items))
    assert sorted((r["doc_id"], r["item_ids"]) for r in found) == [(4, "1"), (5, "1")]
    kept = decontaminate.remove_contaminated(odd_documents, items)
    assert kept.columns == odd_documents.columns
    assert kept.count() == odd_documents.count() - 3
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 30)
    assert rows(decontaminate.contaminated(odd_documents, items)) == found
    assert decontaminate.remove_contaminated(odd_documents, items.limit(0)).count() == odd_documents.count()
    assert decontaminate.remove_contaminated(odd_documents.limit(0), items).count() == 0


# languages

def test_language_query(spark, documents):
    found = {r["doc_id"]: r for r in rows(queries.op8(spark, TABLES))}
    hits = []
    for d in rows(documents):
        r = found.pop(d["doc_id"])
        assert r["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1
        if r["held_out"]:
            hits.append(r["lang_pred"] == d["lang"])
    assert not found and np.mean(hits) >= 0.9


def test_language_of_odd_rows(odd_documents):
    learned = language.learn(odd_documents)
    assert set(learned) == {"de", "en"}
    found = rows(language.identify(odd_documents, learned))
    for r in found:
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters)
        assert letters or (r["score"] == 0 and r["rejected"])
    assert [r["host"] for r in found] == ["x"] * len(found)
    assert rows(language.identify(odd_documents.limit(0), learned)) == []
    nothing = rows(language.identify(odd_documents, language.learn(odd_documents.limit(0))))
    assert {r["lang_pred"] for r in nothing} == {"und"}


# lines

def test_lines_of_odd_rows(spark, odd_documents):
    pages = [(i, "site", f"own line {i}\n  footer \n\nmenu" + ("\nrare" if i < 2 else "")) for i in range(20)]
    pages += [(100, "other", "footer\nmenu"), (101, None, "footer"), (102, "site", None), (103, "site", "")]
    pages += [(i, "small", "same") for i in range(200, 204)]
    table = spark.createDataFrame(pages, "doc_id long, source string, text string")
    found = {r["doc_id"]: r for r in rows(lines.remove_boilerplate(table))}
    assert found[0]["text"] == "own line 0\n\nrare" and found[0]["n_lines"] == 5 and found[0]["n_dropped"] == 2
    assert found[5]["text"] == "own line 5\n"
    assert found[100]["text"] == "footer\nmenu" and found[101]["text"] == "footer"
    assert found[102]["text"] is None and found[102]["n_lines"] == 0
    assert found[103]["text"] == "" and found[103]["n_lines"] == 1
    assert found[200]["text"] == "same"  # on every page, but of fewer than five
    odd = lines.remove_boilerplate(odd_documents)
    assert odd.columns == [c for c in odd_documents.columns if c != "n_lines"] + ["n_lines", "n_dropped"]
    assert odd.count() == odd_documents.count()
    assert lines.remove_boilerplate(odd_documents.limit(0)).count() == 0


def test_many_boilerplate_lines_join_without_broadcast(spark, monkeypatch):
    pages = [(i, f"s{i % 3}", f"head {i % 3}\nbody {i}") for i in range(30)]
    table = spark.createDataFrame(pages, "doc_id long, source string, text string")
    one = sorted(map(str, rows(lines.remove_boilerplate(table))))
    monkeypatch.setattr(lines, "BROADCAST_LINES", 0)
    assert sorted(map(str, rows(lines.remove_boilerplate(table)))) == one
    assert all("head" not in r for r in one)
