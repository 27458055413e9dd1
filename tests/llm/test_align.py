"""Alignment of whole texts, token by token in plain Python, against pointer jumping over kept words."""

import base64
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import align, queries

RNG = random.Random(11)
ALPHABET = [*"abcdefgXYZ0189.,;!?'\"-_", "é", "ß", "日", "本", "😀", "́", "\xa0", "\x00", "\x1c", "\x85", "　", "﻿", "▁", "<0x41>",
            "<|endoftext|>", "</s>", "'s", "'ll", "\n", "\t", "\r\n", "  ", " "]


def noise(n):
    return "".join(RNG.choice(ALPHABET) + RNG.choice(["", "", " ", "word", "tion"]) for _ in range(n))


PLAIN = "Is and retitioning ouen the of, nterti thorreou ndernt.\nIs ndble whst the by for and threea."
TEXTS = [PLAIN, PLAIN + " the the", None, "", " ", "a", " a", "a ", "a  b", "a \n b", "\na b", "a b\n", "a　 b", "x▁y z", "it's we'll <|endoftext|> <s> <0x0A> ok",
         "É" * 300, "w" * 3000, "日本語 テキスト 😀 x", "0 1 22 333 4444", "a\x00b c", " ".join(RNG.choice(PLAIN.split()) for _ in range(20_000)),
         *[noise(RNG.randrange(1, 60)) for _ in range(250)]]
SCHEMA = "doc_id long, text string, row string, pairs string, n long, pair long"
ROWS = [(k, t, "a", "b", 1, 2) for k, t in enumerate(TEXTS)] + [(0, PLAIN, "a", "b", 1, 2), (None, "no id", None, None, None, None)]


@pytest.fixture(scope="module")
def brute():
    """For each row of ROWS: its groups, and how often each pair of ids is linked."""
    import public_tokenizers as files
    import tiktoken
    from sentencepiece import SentencePieceProcessor

    ranks = {base64.b64decode(x): int(y) for x, y in map(bytes.split, open(files.path("byte_bpe_50k.tiktoken"), "rb"))}
    first = tiktoken.Encoding("first", pat_str=files.PATTERN, mergeable_ranks=ranks, special_tokens={})
    second = SentencePieceProcessor(model_file=files.path("piece_bpe_32k.model"))

    def spans(tokens):
        out, at = [], 0
        for ident, raw in tokens:
            out.append((at, at + len(raw), ident))
            at += len(raw)
        return out

    def align_one(text):
        if not text:
            return [], Counter()
        want = (" " + text).encode()
        a = [(k, first.decode_single_token_bytes(k)) for k in first.encode_ordinary(" " + text)]
        b = [(k, bytes([int(p[3:5], 16)]) if second.is_byte(k) else p.replace("▁", " ").encode())
             for k in second.encode(text) for p in [second.id_to_piece(k)]]
        if b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            return [], Counter()
        a, b = spans(a), spans(b)
        cuts = sorted({e for _, e, _ in a} & {e for _, e, _ in b})
        groups, links, low, i, j = [], Counter(), 0, 0, 0
        for cut in cuts:
            ga, gb = [], []
            while i < len(a) and a[i][1] <= cut:
                ga.append(a[i])
                i += 1
            while j < len(b) and b[j][1] <= cut:
                gb.append(b[j])
                j += 1
            links.update((x[2], y[2]) for x in ga for y in gb if x[0] < y[1] and y[0] < x[1])
            groups.append(",".join(str(x[2]) for x in ga) + "|" + ",".join(str(x[2]) for x in gb))
            low = cut
        assert low == len(want)
        return groups, links

    return [align_one(r[1]) for r in ROWS]


def expected(brute):
    held, best = Counter(), defaultdict(int)
    for _, links in brute:
        held.update(set(links))
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    out = []
    for (doc_id, *_), (groups, links) in zip(ROWS, brute, strict=True):
        text = ";".join(groups)
        out.append((doc_id, sum(len(g.split("|")[0].split(",")) for g in groups), sum(len(g.split("|")[1].split(",")) for g in groups),
                    len(groups), sum(links.values()), sum(n for (a, b), n in links.items() if held[a, b] == best[a]),
                    sum(n * held[p] for p, n in links.items()), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return sorted(out, key=str)


NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.mark.parametrize("broadcast_pairs", [0, 60, align.BROADCAST_PAIRS])
def test_counts(spark, brute, broadcast_pairs):
    """Rare pairs by a shuffle, common ones by broadcast, and all by either."""
    docs = spark.createDataFrame(ROWS, SCHEMA).repartition(3)
    rows = align.alignment_counts(docs, broadcast_pairs=broadcast_pairs).collect()
    assert sorted((tuple(r[n] for n in NAMES) for r in rows), key=str) == expected(brute)
    zero = [r for r in rows if r.doc_id in (2, 3)]
    assert all(tuple(r[n] for n in NAMES[1:]) == (0, 0, 0, 0, 0, 0, "") for r in zero)


def test_groups_and_small_stores(spark, brute, monkeypatch):
    docs = spark.createDataFrame(ROWS, SCHEMA).coalesce(1)
    wanted = sorted((r[0], ";".join(g)) for r, (g, _) in zip(ROWS, brute, strict=True) if r[0] is not None)
    rows = align.align_tokens(docs, with_groups=True).collect()
    assert sorted((r.doc_id, r.groups) for r in rows if r.doc_id is not None) == wanted and len({r.row for r in rows}) == len(ROWS)
    for kept, size in ((5, 1 << 20), (10**6, 10)):  # stores that are trimmed and cleared all the time
        monkeypatch.setattr(align, "KEPT_WORDS", kept)
        monkeypatch.setattr(align, "KEPT_BYTES", size)
        store = align.Aligned(*(k(p) for k, p in zip((align.ByteTokenizer, align.PieceTokenizer), align.default_paths(), strict=True)))
        for at in range(0, len(ROWS) - 1, 7):
            texts = [r[1] for r in ROWS[at : min(at + 7, len(ROWS) - 1)]]
            assert align._rows(store, texts)[1] == [";".join(brute[at + k][0]) for k in range(len(texts))]


def test_pointers_reach_the_common_ends():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, int(rng.integers(0, n + 1))), n)) for _ in range(2)]
        label = align.jump(align.successors(*ends))
        common = np.intersect1d(*ends)
        for side, at in ((ends[0], label[: len(ends[0])]), (ends[1], label[len(ends[0]) :])):
            assert (ends[0][at] == common[np.searchsorted(common, side)]).all()
        starts = [np.append(0, e[:-1]) for e in ends]
        pairs = {(i, j) for i in range(len(ends[0])) for j in range(len(ends[1]))
                 if starts[0][i] < ends[1][j] and starts[1][j] < ends[0][i]}
        found = list(zip(*(x.tolist() for x in align.overlaps(*ends)), strict=True))
        assert len(found) == len(set(found)) and set(found) == pairs


def test_empty_table_and_no_tokens(spark):
    assert align.alignment_counts(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = align.alignment_counts(spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(tuple(r[n] for n in NAMES) for r in rows) == [(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)]


def test_registered_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = queries.QUERIES["op11_cross_tokenizer_alignment"](spark, sf_dir)
    assert out.columns == NAMES and out.count() == docs.count()
    assert out.filter((F.col("n_a") > 0) & ((F.col("n_best") > F.col("n_links")) | (F.col("count_sum") < F.col("n_links")))).count() == 0
