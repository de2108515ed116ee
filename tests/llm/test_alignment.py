import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from compare import SF
from tokenizers import Tokenizer

from rulewright.llm import alignment, queries

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def plain(texts):
    """The contract's rows by loops over tokens: a merge for the groups, all pairs of spans for the links."""
    book = Tokenizer.from_file(A)
    book.encode_special_tokens = True
    model = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(b): b for b in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    letters |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in letters.values())}
    vocab = {i: t for t, i in book.get_vocab().items()}

    def a_bytes(i):
        return bytes(letters[c] for c in vocab[i])

    def b_bytes(i):
        return bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()

    def upto(side, cut):
        for _, y, i in side:
            yield str(i)
            if y == cut:
                return

    def spans(ids, size):
        out, at = [], 0
        for i in ids:
            out.append((at, at + len(size(i)), i))
            at = out[-1][1]
        return out

    docs, total = [], Counter()
    for key, text in texts:
        a = book.encode(" " + text, add_special_tokens=False).ids if text else []
        b = model.encode(text) if text else []
        whole = (" " + text).encode() if text else b""
        if not text or b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            docs.append((key, [], [], []))
            continue
        a, b = spans(a, a_bytes), spans(b, b_bytes)
        j, links = 0, []
        for x, y, i in a:
            while b[j][1] <= x:
                j += 1
            k = j
            while k < len(b) and b[k][0] < y:
                links.append((i, b[k][2]))
                k += 1
        total.update(links)
        docs.append((key, a, b, links))
    best = {}
    for (_, j), n in total.items():
        best[j] = max(best.get(j, 0), n)
    rows = []
    for key, a, b, links in docs:
        cuts = sorted({y for _, y, _ in a} & {y for _, y, _ in b})
        sides = [iter(a), iter(b)]
        groups = ["|".join(",".join(upto(side, cut)) for side in sides) for cut in cuts]
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        rows.append((key, len(a), len(b), len(cuts), len(links), sum(total[x] == best[x[1]] for x in links), sum(total[x] for x in links), sha))
    return sorted(rows, key=str)


def got(df):
    names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


@pytest.mark.parametrize("rows", [200])
def test_op13_equals_brute_force(spark, rows):
    texts = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet").select(["doc_id", "text"]).to_pylist()]
    short = [t for t in texts if len(t[1] or "") < 20_000]
    df = spark.createDataFrame(short, "doc_id long, text string")
    assert got(alignment.digest(df, A, B)) == plain(short)
    whole = queries.op13_tokenizer_alignment(spark, SF)
    assert whole.count() == len(texts)


def test_op13_edges(spark):
    texts = [
        (1, None), (1, ""), (2, " "), (2, "   a  b \n\n c\t"), (3, "<|endoftext|> <s> </s> <0x41>"), (4, "▁x"), (5, "ﬁ é é"), (6, "\U0001f600\U0001f468‍\U0001f469 你好"),
        (None, "same text here."), (None, "same text here."), (7, "\x00\x01 nul"), (8, "word " * 3000), (9, "antidisestablishmentarianism" * 20), (10, " " * 9000 + "x"),
    ]
    df = spark.createDataFrame([(*t, 1, "b") for t in texts], "doc_id long, text string, block long, id string")
    assert got(alignment.digest(df, A, B)) == plain(texts)
    assert alignment.digest(df.limit(0), A, B).count() == 0
    for r in alignment.align(df, A, B).collect():
        sizes = (len(r["a_ids"]), len(r["b_ids"]))
        assert (r["a_cuts"][-1], r["b_cuts"][-1]) == sizes if any(sizes) else r["a_cuts"] == r["b_cuts"] == []
    counts = {(r["a_id"], r["b_id"]): (r["n"], r["best"]) for r in alignment.pair_counts(df, A, B).collect()}
    assert sum(n for n, _ in counts.values()) == sum(r[4] for r in plain(texts))


def test_blocks_change_nothing(spark, monkeypatch):
    texts = [(i, " ".join(random.Random(i % 5).choices(["alpha", "beta", "gammas", "delta-x", "3.14"], k=30))) for i in range(40)]
    monkeypatch.setattr(alignment, "BLOCK_CHARS", 500)
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(6)
    assert got(alignment.digest(df, A, B)) == plain(texts)


def test_pointer_jumping_equals_common_ends():
    draw = random.Random(2)
    for _ in range(300):
        n = draw.randint(1, 60)
        a, b = (np.array(sorted({n, *draw.sample(range(1, n + 1), draw.randint(0, n - 1))})) for _ in range(2))
        common = np.intersect1d(a, b)
        ga, gb = alignment.group_numbers(a, b)
        assert ga.tolist() == np.searchsorted(common, a).tolist() and gb.tolist() == np.searchsorted(common, b).tolist()
        at, bt = alignment.overlaps(a, b)
        low = lambda ends: np.concatenate(([0], ends[:-1]))
        assert set(zip(at.tolist(), bt.tolist(), strict=True)) == {(i, j) for i in range(len(a)) for j in range(len(b)) if low(a)[i] < b[j] and low(b)[j] < a[i]}


def test_group_texts_equal_a_loop_over_tokens():
    """The text of a block's groups comes from one take on a table of numerals."""
    draw = random.Random(5)
    for _ in range(100):
        docs = []
        for _ in range(draw.randint(0, 6)):
            n = draw.randint(0, 5)
            sizes = [[draw.randint(1, 3) for _ in range(n)] for _ in range(2)]
            docs.append([[[draw.randrange(50_257 if k == 0 else 32_000) for _ in range(n)] for n in side] for k, side in enumerate(sizes)])
        found = {}
        for k, name in enumerate("ab"):
            ids = [[i for g in d[k] for i in g] for d in docs]
            cuts = [np.cumsum([len(g) for g in d[k]]).tolist() for d in docs]
            for c, lists in ((f"{name}_ids", ids), (f"{name}_cuts", cuts)):
                found[c] = np.array([i for x in lists for i in x], np.int64), np.cumsum([0, *map(len, lists)])
        want = [";".join("|".join(",".join(map(str, g)) for g in pair) for pair in zip(*d, strict=True)) for d in docs]
        assert [bytes(t).decode() for t in alignment._group_texts(found)] == want
