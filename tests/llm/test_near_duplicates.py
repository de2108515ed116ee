"""Min-max hashing and line dedup against brute force, and their edge cases."""

import re
from collections import Counter
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from compare import SF
from pyspark.sql import functions as F

from rulewright.llm import lines, minhash, queries
from rulewright.llm.components import connected_components
from rulewright.storage import Workspace

LOWER = {c: c + 32 for c in range(65, 91)}


def word_sets(texts, width):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    return out


def components(keys, linked):
    """Smallest key reachable of each position."""
    parent = list(range(len(keys)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        parent[max(a, b, key=keys.__getitem__)] = min(a, b, key=keys.__getitem__)
    return [keys[find(i)] for i in range(len(keys))]


def alike(sets, percent=80):
    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    near = {p for h in holders.values() for p in combinations(h, 2)}
    for i, j in near:
        both = len(sets[i] & sets[j])
        if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
            yield i, j


def test_op1_equals_brute_force(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    sets = word_sets(d["text"], 4)
    got = queries.op1_minhash_near_dedup(spark, SF).toPandas().set_index("doc_id").loc[d["doc_id"]]
    assert got["n_shingles"].tolist() == [len(s) for s in sets]
    assert got["component_id"].tolist() == components(d["doc_id"].tolist(), alike(sets))
    assert (got["kept"] == (got.index == got["component_id"])).all()


def test_op1_near_copies_that_are_not_all_alike(docs):
    """Copies with random edits: many pairs of one bucket are below the similarity, and none may be linked or lost."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(10**6)}" for _ in range(120)]
    rows = []
    for i in range(150):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs(rows), width=4).collect()}
    want = components(list(range(150)), alike(word_sets([t for _, t in rows], 4)))
    assert [got[i] for i in range(150)] == want


def test_op1_edges(docs, empty):
    said = "one two three four five six seven eight nine ten"
    rows = [(5, said), (3, said.upper() + " \t"), (4, None), (6, ""), (7, " \n"), (8, "a b"), (9, "A  B"), (9, "A  B"), (None, said), (10, "é " * 50_000), (11, "K a b c"), (12, "K a b c")]
    df = docs(rows).withColumn("id", F.lit(1)).withColumn("n_shingles", F.lit("x")).withColumn("bands", F.lit(0))
    got = minhash.near_duplicates(df, width=4).collect()
    assert len(got) == len(rows)
    part = {r["doc_id"]: r["component_id"] for r in got}
    assert part == {5: 3, 3: 3, 4: 4, 6: 6, 7: 7, 8: 8, 9: 8, None: None, 10: 10, 11: 11, 12: 12}
    assert {r["doc_id"]: r["n_shingles"] for r in got}[4] == 0
    assert minhash.near_duplicates(empty).collect() == []
    kept = minhash.keep_first(df, width=4)
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [3, 4, 6, 7, 8, None, 10, 11, 12]))
    assert kept.columns == df.columns


def test_op1_one_id_on_different_texts(docs):
    """Rows of one id are documents of their own; only the copy goes."""
    said, other = "one two three four five six seven eight nine ten", "quite another text with other words in it today"
    df = docs([(1, said), (2, said), (2, other), (2, other), (3, f"{other} ."), (4, f"{said} 11"), (4, "none of the above words")])
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, width=4).collect())
    assert got == [(1, 7, 1, True), (2, 6, 2, True), (2, 6, 2, True), (2, 7, 1, False), (3, 7, 2, False), (4, 2, 4, True), (4, 8, 1, False)]
    kept = sorted((r["doc_id"], r["text"]) for r in minhash.keep_first(df, width=4).collect())
    assert kept == [(1, said), (2, other), (2, other), (4, "none of the above words")]
    near = docs([(5, said), (5, f"{said} 11")])
    assert minhash.keep_first(near, width=4).count() == 1


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(60)]
    star = [(1000, 1001 + i) for i in range(60)]
    edges = spark.createDataFrame([*chain, *star, (7, 7), (None, 3)], "a long, b long")
    got = {r["node"]: r["component"] for r in connected_components(edges, Workspace(spark, "test")).collect()}
    assert got == {i: 0 for i in range(61)} | {1000 + i: 1000 for i in range(61)}


def test_op10_edges(docs, empty):
    long_line = "the quick brown fox jumps over the lazy dog and then it runs home again to sleep under the old oak tree by the river bank"
    rows = [(2, f"{long_line}\n\nown line here"), (1, f"  {long_line.upper()}\r\nother"), (3, None), (4, ""), (5, f"x\n{long_line}!"), (6, "語" * 200), (7, "語" * 199 + "x"), (None, long_line), (8, "a" * 100_000)]
    df = docs(rows).withColumn("line", F.lit(1)).withColumn("n_lines", F.lit("x"))
    got = {r["doc_id"]: r for r in lines.drop_repeated(df).collect()}
    assert got[1]["text"] == f"  {long_line.upper()}\r\nother" or got[None]["text"] == long_line
    assert got[2]["text"] == "\nown line here"
    assert (got[2]["n_lines"], got[2]["n_removed"]) == (3, 1)
    assert got[5]["text"] == "x"
    assert got[3]["text"] is None
    assert (got[4]["text"], got[4]["n_lines"]) == ("", 1)
    assert got[7]["n_lines"] == 1
    assert got[None]["text"] == long_line
    assert lines.drop_repeated(empty).collect() == []
    assert lines.drop_repeated_documents(df.drop("n_lines")).columns == df.drop("n_lines").columns


def character_sets(said, width=5):
    """Character shingles in plain Python, without the library's pattern."""
    said = [x.strip(" \t\r").lower() for x in said]
    return [{x[i : i + width] for i in range(max(1, len(x) - width + 1))} for x in said]


SHORT = "the quick brown fox jumps over the lazy dog and then it runs home again to sleep"


def test_op10_ordinary_lines_with_small_changes(docs):
    said = [SHORT, f"{SHORT}!", SHORT.replace("lazy", "lasy"), "a sentence of its own", "a sentence of its own.", "abc", "abcd", "日本語の文章をここに書きます。とても長い文章です", "日本語の文章をここに書きます。とても長い文章です。"]
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated(docs(list(enumerate(said)))).collect()}
    assert got == {i: x if i not in (1, 2, 4, 8) else "" for i, x in enumerate(said)}


def test_op10_equals_brute_force_of_character_shingles(spark):
    d = pd.read_parquet(f"{SF}/documents.parquet")
    at = [(i, k) for i, t in zip(d["doc_id"], d["text"], strict=True) for k, x in enumerate(t.split("\n")) if x.strip(" \t\r")]
    said = dict(zip(d["doc_id"], (t.split("\n") for t in d["text"]), strict=True))
    first = components(at, close_pairs(character_sets([said[i][k] for i, k in at])))
    gone = {a for a, f in zip(at, first, strict=True) if a != f}
    got = queries.op10_line_dedup(spark, SF).toPandas().set_index("doc_id")
    for i, x in said.items():
        assert got.loc[i, "text"] == "\n".join(y for k, y in enumerate(x) if (i, k) not in gone)


def close_pairs(sets, percent=80):
    """All pairs of alike sets; a pair of them shares one of the rarest shingles of either set."""
    counts = Counter(x for s in sets for x in s)
    holders, seen = {}, set()
    for i, s in enumerate(sets):
        for x in sorted(s, key=lambda x: (counts[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]:
            for j in holders.setdefault(x, []):
                if (j, i) not in seen:
                    seen.add((j, i))
                    both = len(sets[j] & s)
                    if 100 * both >= percent * (len(sets[j]) + len(s) - both):
                        yield j, i
            holders[x].append(i)


def test_op10_one_id_on_different_texts(docs):
    """Only the repeated line goes; no line is lost for another row's sake."""
    got = lines.drop_repeated(docs([(1, SHORT), (2, SHORT), (2, "quite another text\nwith two lines"), (2, f"more of it\n{SHORT}!")])).collect()
    assert sorted((r["doc_id"], r["text"], r["n_removed"]) for r in got) == [(1, SHORT, 0), (2, "", 1), (2, "more of it", 1), (2, "quite another text\nwith two lines", 0)]


def test_op10_rows_that_are_equal_are_one_document(docs):
    got = lines.drop_repeated(docs([(3, f"{SHORT}\nown"), (3, f"{SHORT}\nown"), (1, SHORT)])).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == [(1, SHORT), (3, "own"), (3, "own")]


def test_op10_pairs_of_opened_buckets_are_compared_once(spark):
    """Lines that meet in several opened buckets, in one block or two, are verified with each other in one of them, and never within a component."""
    said = {1: SHORT, 2: f"{SHORT}!", 3: SHORT.replace("lazy", "idle").replace("quick", "speedy"), 4: f"{SHORT}?"}
    part = {1: 1, 2: 2, 3: 3, 4: 2}
    texts = spark.createDataFrame([(i, t, 0, 0, 0, 0) for i, t in said.items()], ["line", "said", *lines.SKETCH])
    for blocks in (1, 2, 3):
        held = {7: (1, 2, 3, 4), 8: (1, 2, 3), 9: (1, 2, 4)}
        opened = spark.createDataFrame([(k, i, part[i], blocks) for k, of in held.items() for i in of], "key long, line long, part long, blocks long")
        compared = lines._compared(opened, texts, 80)
        met = Counter(tuple(sorted((r["ms"][p["x"]]["said"], r["ms"][p["y"]]["said"]))) for r in compared.collect() for p in r["pairs"])
        assert met == {tuple(sorted((said[i], said[j]))): 1 for i, j in combinations(said, 2) if part[i] != part[j]}
        assert [tuple(r) for r in lines._bucket_links(compared, 80).collect()] == [(1, 2)]


def test_op10_recall_at_the_threshold(docs):
    """Pairs of similarity 0.8 to 0.82 with 5 to 40 shingles, made from distinct characters: about 2e-4 to 1e-3 of them may be missed."""
    import random

    rng, rows, n = random.Random(8), [], 0
    for size in range(5, 41):
        for _ in range(25):
            said = "".join(chr(rng.randrange(0x4E00, 0x9F00)) for _ in range(size + 4))
            cut = size - -(-8 * size // 10)
            rows += [(n, said), (n + 1, said[: len(said) - cut])]
            n += 2
    got = {r["doc_id"]: r["text"] for r in lines.drop_repeated(docs(rows)).collect()}
    assert all(got[i] == said for i, said in rows if i % 2 == 0)
    assert sum(got[i] != "" for i, said in rows if i % 2) <= 6


def test_op1_words_that_differ_stay_apart(docs):
    # Thue-Morse words and their complements: alike under every polynomial hash modulo a power of two.
    def pair(n):
        bits = [bin(i).count("1") % 2 for i in range(n)]
        return ["".join("ab"[b ^ flip] for b in bits) for flip in (0, 1)]

    rows = [t for n in (1024, 2048, 4096) for t in pair(n)]
    rows += [f"one two {w} three four five six" for w in pair(2048)]
    df = docs([(i, t) for i, t in enumerate(rows)])
    assert all(r["kept"] for r in minhash.near_duplicates(df, width=4, percent=80).collect())
    assert minhash.keep_first(df, width=5, percent=80).count() == len(rows)


def test_memory_of_a_worker_is_that_of_a_chunk():
    """The arrays of signatures and of language scores are those of a bounded piece of text, whatever the batch holds."""
    import tracemalloc

    from rulewright.llm import langid, shingles

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 9000, 700)) for _ in range(600)]
    model = langid.Model(["a", "b"], np.ones(2), (np.array([1, 2]), np.array([0, 1]), np.array([1, 1])))
    model.score(texts[:1])
    n = 0
    tracemalloc.start()
    for _ in shingles.shingle_sets([t.encode() for t in texts], 5):
        n += 1
    signed = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    model.score(texts)
    scored = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n > 2
    assert signed < 40e6
    assert scored < 60e6


def test_workspace_bounds_the_batches_of_one_write(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    ws = Workspace(spark, "batches")
    out = ws.save(spark.range(50, numPartitions=1).mapInArrow(sizes, "n long"), "bounded", 7)
    assert max(r["n"] for r in out.collect()) <= 7
    assert spark.conf.get(key) == before
