"""Every operator on small rows with nulls, ties, repeats, long texts and clashing names, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (bytetext, decontaminate, exact_dedup, fm_index, language_id, license_scan, ngram_join, pack, passages, queries,
                          sparse_suffix, token_files, tokens, toxicity)

SCHEMA = "doc_id long, text string, lang string, id string, n string, digest string, q string"
RNG = random.Random(5)
VOCABULARY = [f"w{k}" for k in range(400)]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY) for _ in range(n))


PASSAGE, BASE = prose(60), prose(120)
NEAR = " ".join(BASE.split()[:-1] + ["other"])
TEXTS = [BASE, NEAR, BASE.upper(), "  ".join(BASE.split()), prose(30) + " " + PASSAGE + " " + prose(30), prose(20) + " " + PASSAGE, PASSAGE, None, "", " \t\n",
         "one two", "one  two", "ÉCOLE Licensed under the Apache License, Version 2.0.", "GNU General Public License; cc-by, MIT license mit license",
         "12 34 !!", prose(9000), PASSAGE + " " + PASSAGE, "x" * 5000, "日本語 é", prose(30)]
ROWS = [(10 + k, t, ("en", "de", None)[k % 3], "a", "b", "c", "d") for k, t in enumerate(TEXTS)]
ROWS += [ROWS[0], ROWS[4], (None, "no id at all", "en", "a", "b", "c", "d")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def bench(spark):
    rows = [(7, PASSAGE), (8, "one two"), (70, PASSAGE), (9, None), (11, "")]
    return spark.createDataFrame(rows, "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(10 + k, k % 2) for k in range(12)] + [(10, 1), (11, None)], "doc_id long, toxic int")


def rows_of(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def lowered(text, pattern):
    return re.findall(pattern, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def test_exact_copies(docs):
    groups = {}
    for key, text, *_ in ROWS:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), key is None, key))
    want = []
    for key, text, *_ in ROWS:
        content = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best = min(groups[content])
        want.append((key, best[2], len(groups[content]), best == (-len(text or ""), key is None, key), hashlib.sha256(content.encode()).hexdigest()))
    assert rows_of(exact_dedup.mark_copies(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == sorted(want, key=str)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)


def brute_hits(text, items):
    words, hit, seen = lowered(text, WORD), set(), set()
    for item, body in items:
        grams = lowered(body, WORD)
        size = min(13, len(grams))
        windows = {tuple(grams[p : p + size]) for p in range(len(grams) - size + 1)} if grams else set()
        for p in range(len(words) - size + 1) if grams else ():
            if tuple(words[p : p + size]) in windows:
                hit |= set(range(p, p + size))
                seen.add(str(item))
    return len(words), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest()


def test_benchmark_passages(docs, bench):
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = [(key, *(b := brute_hits(text, items)), b[1] > 0 and 20 * b[1] >= b[0]) for key, text, *_ in ROWS]
    found = decontaminate.mark_contaminated(docs, bench)
    assert rows_of(found, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == sorted(want, key=str)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not w[-1] for w in want)
    spans = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, "spans").collect()}
    assert spans[16] == "" and spans[20] == "" and spans[10] == BASE and spans[17] is None


def test_a_large_benchmark_is_joined_by_a_shuffle(docs, bench, monkeypatch):
    want = rows_of(decontaminate.mark_contaminated(docs, bench), "doc_id", "n_hit", "n_items")
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows_of(decontaminate.mark_contaminated(docs, bench), "doc_id", "n_hit", "n_items") == want


def test_licenses(docs):
    want = []
    for key, text, *_ in ROWS:
        words, at, labels = lowered(text, WORD), [], set()
        for phrase, label in license_scan.PHRASES.items():
            p = phrase.split()
            some = [k for k in range(len(words)) if words[k : k + len(p)] == p]
            at += some
            labels |= {label} if some else set()
        want.append((key, len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))))
    found = license_scan.scan_licenses(docs)
    assert rows_of(found, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == sorted(want, key=str)
    by = {r.doc_id: r for r in found.collect()}
    assert by[22].labels == "apache,apache-2.0-notice" and by[22].score == 1.0 and by[10].labels == "" and by[10].score == 0.0


def test_a_changed_notice_is_found(spark):
    text = "permission is hereby granted free of charge to any person obtaining one copy of this software and associated documentation " \
           "files to deal in the software without any restriction including without limitation the rights to use copy modify merge publish " \
           "distribute sublicense and or sell copies of the software"
    found = license_scan.scan_licenses(spark.createDataFrame([(1, text), (2, "permission is hereby granted free of charge")], "doc_id long, text string"))
    assert rows_of(found, "doc_id", "labels") == [(1, "mit-grant"), (2, "")]


LICENSED = {
    "Licensed under the Apache License, Version 1.0.": "apache,apache-1.0-notice",
    "Licensed under the Apache License, Version 1.1.": "apache,apache-1.1-notice",
    "Licensed under the Apache License, Version 2.0.": "apache,apache-2.0-notice",
    "Licensed under the Apache License, Version 2": "apache,apache-2.0-notice",
    "This work is licensed under the GNU General Public License, version 1": "gpl,gpl-1.0-notice",
    "This work is licensed under the GNU General Public License, version 2": "gpl,gpl-2.0-notice",
    "This work is licensed under the GNU General Public License, version 3.": "gpl,gpl-3.0-notice",
    "This work is licensed under the GNU General Public License (GPL) v2": "gpl,gpl-2.0-notice",
    "This work is licensed under the GNU General Public License.": "gpl",
    "This work is licensed under the GNU Lesser General Public License, version 2.1.": "lgpl-2.1-notice",
    "This work is licensed under the GNU Lesser General Public License, version 3.": "lgpl-3.0-notice",
    "This work is licensed under the GNU Affero General Public License, version 3": "agpl-3.0-notice",
    **{f"Licensed under CC BY-NC {v}.": f"cc-by,cc-by-nc-{v}-notice" for v in ("1.0", "2.0", "2.5", "3.0", "4.0")},
    "Licensed under CC BY-NC-SA 4.0.": "cc-by",
    "Released under the MIT License.": "mit,mit-notice",
    "Released under the MIT No Attribution License.": "",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/": "",
    "You may not use this file except in compliance with the License. You may obtain a copy of the License at "
    "http://www.apache.org/licenses/LICENSE-2.0": "apache-2.0-grant",
    "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software "
    "Foundation, either version 3 of the License, or any later version": "",
    "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software "
    "Foundation, either version 2 of the License, or any later version": "gpl,gpl-grant",
}


def test_versions_of_a_license_are_told_apart(spark):
    rows = [(k, f"one two three. {text} Four five six seven.") for k, text in enumerate(LICENSED)]
    found = license_scan.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {rows[r.doc_id][1]: r.labels for r in found} == {rows[k][1]: labels for k, labels in enumerate(LICENSED.values())}


def shingles(text):
    words = lowered(text, r"[^\x20\x09-\x0D]+")
    return {tuple(words[k : k + 4]) for k in range(len(words) - 3)} if len(words) > 3 else {tuple(words)} if words else set()


def test_similar_documents(spark):
    rng, rows = random.Random(3), []
    for family in range(12):
        body = [rng.choice(VOCABULARY) for _ in range(rng.choice([5, 40, 150]))]
        for _ in range(12):
            copy = list(body)
            for _ in range(rng.randrange(5)):
                copy[rng.randrange(len(copy))] = rng.choice(VOCABULARY)
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + k, t) for k, t in enumerate([None, "", "one two", "ONE two", "one"])]
    sets = {k: shingles(t) for k, t in rows}
    least = {k: k for k in sets}

    def root(k):
        while least[k] != k:
            k = least[k]
        return k

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = ngram_join.similar_documents(df)
    assert rows_of(found, "doc_id", "n_shingles", "component_id") == sorted(((k, len(s), root(k)) for k, s in sets.items()), key=str)
    assert ngram_join.drop_similar(df).count() == len({root(k) for k in sets})


def test_divide_skip_agrees_with_intersections():
    rng = np.random.default_rng(1)
    for _ in range(200):
        query = np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64))
        sets = [np.unique(np.concatenate([query[rng.random(len(query)) < 0.95], rng.integers(0, 60, rng.integers(1, 4)).astype(np.uint64)])) for _ in range(8)]
        both = [len(np.intersect1d(query, s)) for s in sets]
        assert ngram_join.search(query, sets).tolist() == [100 * b >= 85 * (len(query) + len(s) - b) for b, s in zip(both, sets, strict=True)]


def brute_removed(rows):
    words = [(key if key is not None else -(1 << 63), (text or "").encode().split()) for key, text, *_ in rows]
    first = {}
    for key, w in words:
        for p in range(len(w) - 49):
            g = b" ".join(w[p : p + 50])
            first[g] = min(first.get(g, key), key)
    out = []
    for (key, w), row in zip(words, rows, strict=True):
        gone = {p + k for p in range(len(w) - 49) if first[b" ".join(w[p : p + 50])] < key for k in range(50)}
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((row[0], len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("shard_words", [400_000, 100])
def test_repeated_passages(docs, shard_words):
    want = brute_removed(ROWS)
    found = fm_index.remove_repeats(docs, shard_words=shard_words)
    assert rows_of(found, "doc_id", "n_words", "n_removed", "kept_sha256") == sorted(want, key=str)
    spans = Counter()
    for r in sparse_suffix.repeated_passages(docs, shard_words=shard_words).collect():
        spans[r.doc_id] += r.n_words
        assert r.other_doc_id < r.doc_id
    assert spans == {w[0]: w[2] for w in want if w[2]}


@pytest.mark.parametrize("index", [fm_index, sparse_suffix])
def test_a_passage_in_many_surroundings_meets_in_bounded_shards(spark, index):
    """No index holds more than the budget and one anchor within it, though the passage's anchors have many times as many words."""
    rng, budget, holders = random.Random(9), 1000, index.smallest_holders

    def bounded(hashed, bounds, ids, places, window):
        assert len(hashed) <= 2 * budget, len(hashed)
        return holders(hashed, bounds, ids, places, window)

    def alone(n):
        return " ".join(f"u{rng.random()}" for _ in range(n))

    rows = [(k, f"{alone(60)} {PASSAGE} {alone(60)}") for k in range(60)]
    rows += [(60 + k, f"{alone(9)} {BASE} {alone(9)}") for k in range(2)] + [(62, rows[5][1]), (5, alone(70))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spans = passages.shared_spans(df, bounded, "doc_id", "text", shard_words=budget)
    gone = {}
    for r in spans.collect():
        assert r.by < r.id
        gone.setdefault((r.id, r.key), set()).update(range(r["first"], r["last"]))
    want = {(key, passages._text_key(text)): n for (key, text), (_, _, n, _) in zip(rows, brute_removed(rows), strict=True) if n}
    assert {k: len(v) for k, v in gone.items()} == want and len(want) > 60


@pytest.mark.parametrize("index", [fm_index, sparse_suffix])
def test_every_hit_is_decided_by_the_index(spark, docs, index):
    """An index that finds nothing leaves nothing, whole copies included; each group of segments shows it two documents at most."""
    def blind(hashed, bounds, ids, places, window):
        return [np.full(max(0, n - window + 1), np.iinfo(np.int64).max) for n in np.diff(bounds)]

    assert passages.shared_spans(docs, blind, "doc_id", "text").count() == 0
    copies = spark.createDataFrame([(k, BASE) for k in range(40)], "doc_id long, text string").repartition(4)

    def few(hashed, bounds, ids, places, window):
        assert set(ids.tolist()) == {0, 39}
        return index.smallest_holders(hashed, bounds, ids, places, window)

    spans = passages.shared_spans(copies, few, "doc_id", "text").collect()
    assert {r.id for r in spans} == set(range(1, 40)) and {r.by for r in spans} == {0}


def test_indexes_agree_on_random_words():
    rng = np.random.default_rng(2)
    for _ in range(30):
        parts = [rng.integers(0, 3, rng.integers(6, 14)).astype(np.uint64) for _ in range(9)]
        bounds, ids = np.concatenate([[0], np.cumsum([len(p) for p in parts])]), rng.integers(0, 5, len(parts))
        least = {}
        for p, i in zip(parts, ids, strict=True):
            for k in range(len(p) - 5):
                key = tuple(p[k : k + 6])
                least[key] = min(least.get(key, 99), i)
        got = fm_index.smallest_holders(np.concatenate(parts), bounds, ids, np.zeros(len(parts), int), 6)
        assert [x.tolist() for x in got] == [[least[tuple(p[k : k + 6])] for k in range(len(p) - 5)] for p in parts]


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.default_path())
    return lambda text, end: [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def test_words_encode_as_whole_texts_do(ids):
    texts = ["It's 'tis a,'s b.'t don't, o'clock!!", "école, École. é—, x y z", "a1b2 3.14 #tag @you http://x.y/z?q=1", "İstanbul ΣΣ …. —,", None,
             "Ʃİ& ɏİ. É's ÉCOLE## a\x1cb ẞ. ﬁn! x" + "y" * 200 + "...", "<|endoftext|>b <|ENDOFTEXT|> a"]
    made = tokens.WordEncoder(tokens.default_path()).encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in made] == [ids(t, 0)[:-1] for t in texts]


def test_token_files(docs, ids, tmp_path):
    want, start = [], 0
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0))
    for key, text, *_ in order:
        raw = np.array(ids(text, 2), "<u4").tobytes()
        want.append((key, start, len(raw) // 4, zlib.crc32(raw)))
        start += len(raw) // 4
    found = token_files.round_trip(docs, f"file://{tmp_path}/t")
    assert rows_of(found, "doc_id", "start", "n_tokens", "ids_crc32") == sorted(want, key=str)


def test_planes_round_trip():
    for n in (0, 1, 7, 64, 70_001):
        values = np.random.default_rng(n).integers(0, 50_000, n).astype(np.uint32)
        assert (token_files.from_planes(token_files.to_planes(values), n, np.uint32) == values).all()


def test_packing(docs, ids):
    found = pack.pack_documents(docs).collect()
    pieces = Counter()
    for key, text, *_ in ROWS:
        own = np.array(ids(text, 0), "<u4")
        for k in range(0, len(own), 2048):
            pieces[key, k // 2048, k, len(own[k : k + 2048]), zlib.crc32(own[k : k + 2048].tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == pieces
    bins = {}
    for r in found:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(bins) == -(-sum(r.length for r in found) // 2048)


def test_a_full_set_of_bins_closes_the_fullest():
    bins = pack.OpenBins(10, 2)
    assert [bins.place(x) for x in (6, 7, 8, 3, 4)] == [(0, 0), (1, 0), (2, 0), (0, 6), (3, 0)]
    assert bins.count == 2


def test_languages(spark):
    rng = random.Random(4)
    make = {"aa": "ba be bi bo", "bb": "zur xen qui tak"}
    rows = [(k, " ".join(rng.choice(make[lang].split()) for _ in range(20)), lang) for k in range(80) for lang in [("aa", "bb")[k % 2]]]
    rows += [(100, None, "aa"), (101, "12 !!", "bb"), (102, "", None), (103, "ba be bi ba " * 5 + "zur xen tak " * 6, None), (None, "ba be", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = language_id.identify_held_out(df)
    by = {r.doc_id: r for r in found.collect()}
    assert all(by[k].lang_pred == rows[k][2] for k in range(80)) and {by[k].lang_pred for k in (100, 101, 102)} == {"und"}
    assert all(by[k].held_out == (zlib.crc32(str(k).encode()) % 4 == 2) for k in range(80)) and by[None].held_out is False
    mixed = {r.doc_id: r for r in language_id.language_mixtures(df, language_id.fit_languages(df, language_id.fold("doc_id", 4) != 2)).collect()}
    assert sorted(mixed[103].langs) == ["aa", "bb"] and mixed[0].langs == ["aa"]
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} == {*range(80), 103, None}
    assert {r.lang_pred for r in language_id.identify_held_out(df.filter("lang IS NULL")).collect()} == {"und"}


def test_clean_texts_stay_where_no_language_was_learned(spark):
    df = spark.createDataFrame([(1, "plain words here", None), (2, "12 34 !!", None), (3, None, None), (4, "é", None)], "doc_id long, text string, lang string")
    assert {r.doc_id for r in language_id.keep_identified(df).collect()} == {1, 4}


def test_toxicity(spark):
    rng, rows, marks = random.Random(6), [], []
    for k in range(300):
        words = [rng.choice(VOCABULARY) for _ in range(40)]
        if k % 4 == 0:
            words[rng.randrange(40)] = rng.choice(["badstem", "badstems", "badstemmed"])
        rows.append((k, " ".join(words), "en"))
        marks.append((k, int(k % 4 == 0)))
    rows += [(400, None, None), (401, "", "en")]
    df, marked = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    found = [r for r in toxicity.score_held_out(df, marked).collect()]
    held = [r for r in found if r.held_out and r.doc_id < 300]
    assert len(found) == 302 and sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found)
    assert {r.predicted for r in toxicity.score_held_out(df, marked.filter("toxic = 0")).collect()} == {0}


def test_toxicity_learns_from_every_labelled_row(spark):
    """A few marked words occur in the last rows by hash only, which a first share of the rows does not show; one replica and several tell them."""
    rng, marks = random.Random(12), []
    ids = [r.id for r in spark.sql("SELECT id FROM range(2500) ORDER BY xxhash64(id)").collect()]
    rows = []
    for place, k in enumerate(ids):
        words = [rng.choice(VOCABULARY) for _ in range(15)]
        toxic = int(place % 5 == 1)
        if toxic:
            words[rng.randrange(15)] = "firstbad" if place < 1200 else "laterbad"
        rows.append((k, " ".join(words), "en"))
        marks.append((k, toxic))
    df, marked = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    truth = dict(marks)
    for some in (5000, 1000):
        found = toxicity.score_held_out(df, marked, train_rows=some).collect()
        held = [r for r in found if r.held_out]
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held), some


def test_toxicity_weights_survive_averaging():
    model = toxicity.ToxicityModel.new()
    moments = toxicity.Moments.new(model)
    moments.step, model.out_bias = 7, 0.25
    rows = toxicity._rows(model, moments)
    other = toxicity.ToxicityModel.new(1)
    state = toxicity.Moments.new(other)
    toxicity._unpack(rows, other, state)
    assert state.step == 7 and other.out_bias == 0.25 and np.array_equal(toxicity._rows(other, state), rows)


def test_every_operator_takes_odd_rows_and_empty_tables(spark, docs, bench, labels):
    none = docs.filter("false")
    runs = {
        "licenses": license_scan.scan_licenses, "copies": exact_dedup.mark_copies, "kept": exact_dedup.drop_copies,
        "similar": ngram_join.similar_documents, "fm": fm_index.remove_repeats, "suffix": sparse_suffix.repeated_passages,
        "tokens": token_files.round_trip, "packed": pack.pack_documents, "languages": language_id.identify_held_out,
        "bench": lambda d: decontaminate.mark_contaminated(d, bench), "no bench": lambda d: decontaminate.mark_contaminated(d, bench.filter("false")),
        "toxic": lambda d: toxicity.score_held_out(d, labels),
    }
    for name, run in runs.items():
        assert run(none).count() == 0, name
        if name not in ("kept", "suffix", "packed"):
            assert run(docs).count() == len(ROWS), name


def test_registered():
    assert sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])) == list(dict.fromkeys(
        sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0])))) and len(queries.QUERIES) == 13


def test_toxicity_texts_do_not_move_to_their_labels(spark, monkeypatch):
    """The ids go to the texts whatever their size; beyond the limit they meet by key. Either way every labelled row is taken."""
    rows = [(i, f"{'vile' if i % 3 == 0 else 'kind'} words {i}", "en") for i in range(60)] + [(None, "nobody", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(0, 60, 2)], "doc_id long, toxic int")
    kept = []
    train = toxicity._train_replicas

    def seen(taken, replicas):
        kept.append(sorted(r["_text"] for r in taken.collect()))
        return train(taken, replicas)

    monkeypatch.setattr(toxicity, "_train_replicas", seen)
    joined = []
    join = type(docs).join
    monkeypatch.setattr(type(docs), "join", lambda self, other, *a, **b: joined.append((out := join(self, other, *a, **b))) or out)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for limit, kind in ((5_000_000, "BroadcastHashJoin"), (10, "SortMergeJoin")):
            joined.clear()
            monkeypatch.setattr(toxicity, "SENT_IDS", limit)
            toxicity.fit_toxicity(docs, labels, F.lit(True))
            assert kind in joined[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert kept[0] == kept[1] and len(kept[0]) == 30


def test_likelihoods_of_words_are_those_of_their_trigrams():
    texts = ["Ab ab, abc", "", "x", "... a", "été 12 ÉTÉ"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    table = np.random.default_rng(0).random((language_id.CELLS, 3))
    starts, ends, _ = bytetext.spans(data, offsets, ~bytetext.LETTER)
    at, cells = language_id._trigrams(data, offsets)
    wanted = np.add.reduceat(table[cells], np.searchsorted(at, starts), axis=0)
    assert np.array_equal(language_id._word_sums(table, bytetext.LOWER[data], starts, ends), wanted)
