"""Secrets, language ID, chat formatting, BPE and packing against plain versions, and their edge cases."""

import base64
import hashlib
import json
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from compare import SF, same
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rulewright.llm import bpe, chat, langid, packing, queries, secrets

PATH = public_tokenizers.path("byte_bpe_50k.json")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def table():
    return pd.read_parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


# Secrets


def b64(raw):
    return base64.b64encode(raw).decode()


def der(tag, body):
    n = len(body)
    size = bytes([n]) if n < 128 else bytes([0x82, n >> 8, n & 255])
    return bytes([tag]) + size + body


RSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([0xA1 + i]) * 40) for i in range(8)))
SSH = b"openssh-key-v1\0" + b"".join(len(x).to_bytes(4, "big") + x for x in (b"none", b"none", b"")) + b"\0\0\0\1" + b"x" * 40


def plain_base(text):
    found = []
    for m in re.finditer(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            found.append((m.start(), 0, "assign", m.end()))
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def test_op3_base_spans(spark, table):
    got = queries.op3_secret_scan(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(table["doc_id"], table["text"], strict=True):
        base = plain_base(t)
        assert got.loc[i, "base_sha256"] == sha(",".join(f"{k}:{a}:{b}" for a, _, k, b in base))
        assert [got.loc[i, f"n_{k}"] for k in secrets.BASE_KINDS] == [sum(s[2] == k for s in base) for k in secrets.BASE_KINDS]


def test_op3_structures():
    token = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"alg": "HS256"}, {"sub": "1"})) + ".sig"
    bogus = ".".join(base64.urlsafe_b64encode(json.dumps(x).encode()).decode().rstrip("=") for x in ({"typ": "JWT"}, {"sub": "1"})) + ".sig"
    pem = f"-----BEGIN RSA PRIVATE KEY-----\n{b64(RSA)}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.scan(f"é {token} x")] == ["jwt"]
    assert secrets.scan(f"é {bogus} x") == []
    assert [k for k, _, _ in secrets.scan(pem)] == ["pem", "der"]
    assert secrets.scan(pem.replace("M", "N", 1)) == []
    assert [k for k, _, _ in secrets.scan(b64(SSH))] == ["ssh"]
    assert [k for k, _, _ in secrets.scan(RSA.hex().upper())] == ["der"]
    assert {k for k, _, _ in secrets.scan(RSA.hex())} == {"hex", "der"}
    assert secrets.scan(b64(bytes(range(256)))) == []
    assert secrets.scan("paſsword = abcdefg") == []
    assert secrets.scan("token: abcde") == []
    assert secrets.mask("a token=abcdef b", secrets.scan("a token=abcdef b")) == f"a {secrets.MASK} b"


OID = der(6, b"\x2a\x86\x48\x86\xf7\x0d\x01\x01\x01")
ALGORITHM = der(0x30, OID + der(5, b""))
PKCS8 = der(0x30, der(2, b"\0") + ALGORITHM + der(4, RSA))
EC = der(0x30, der(2, b"\1") + der(4, bytes(range(32))) + der(0xA0, OID) + der(0xA1, der(3, b"\0" + bytes(64))))
ENCRYPTED = der(0x30, der(0x30, OID + der(0x30, der(4, b"saltsalt") + der(2, b"\x08\x00"))) + der(4, bytes(range(96))))
DSA = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([0x71 + i]) * 20) for i in range(5)))
ED25519 = der(0x30, der(2, b"\0") + der(0x30, der(6, b"\x2b\x65\x70")) + der(4, der(4, bytes(range(32)))))


@pytest.mark.parametrize("raw", [PKCS8, EC, ENCRYPTED, DSA, ED25519])
def test_op3_nested_keys(raw):
    assert secrets.is_der_key(raw)
    assert [k for k, _, _ in secrets.scan(f"key {b64(raw)} end")] == ["der"]
    assert not secrets.is_der_key(raw[:-1]) and not secrets.is_der_key(raw + b"\0")


def test_op3_broken_inner_lengths():
    broken = bytearray(PKCS8)
    at = PKCS8.index(RSA) + 4 + 1
    broken[at] += 1  # the length of the inner key's first number; all outer lengths still add up
    assert not secrets.is_der_key(bytes(broken))
    assert not secrets.is_der_key(der(0x30, der(2, b"\0") + der(0x30, der(5, b"")) + der(4, RSA)))
    assert not secrets.is_der_key(der(0x30, der(2, b"\0") + ALGORITHM + der(4, b"x" * 40)))


def test_op3_wrapped_and_glued_keys():
    said = b64(PKCS8)
    wrapped = "\n".join(said[i : i + 64] for i in range(0, len(said), 64))
    assert secrets.scan(f"a {wrapped} b") == [("der", 2, 2 + len(wrapped))]
    assert secrets.scan(f"a xQ{said}") == [("der", 4, 4 + len(said))]
    ssh = b64(SSH)
    assert [k for k, _, _ in secrets.scan(f"xx{ssh}")] == ["ssh"]
    body = b64(bytes(range(128)))
    pem = f"-----BEGIN RSA PRIVATE KEY-----\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,00FF\n\n{body}\n-----END RSA PRIVATE KEY-----"
    assert [k for k, _, _ in secrets.scan(pem)] == ["pem"]
    assert secrets.scan(pem.replace("ENCRYPTED", "CLEAR")) == []


def test_op3_all_spans_of_the_table(spark, table):
    """Every span of the query, base kinds by the plain version and the method's kinds by decoding each span again."""
    got = queries.op3_secret_scan(spark, SF).toPandas().set_index("doc_id")
    for i, t in zip(table["doc_id"], table["text"], strict=True):
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in got.loc[i, "spans"].split(",") if x)]
        assert [s for s in spans if s[0] in secrets.BASE_KINDS] == [(k, a, b) for a, _, k, b in plain_base(t)]
        for kind, a, b in spans:
            if kind == "jwt":
                assert json.loads(base64.urlsafe_b64decode(t[a:b].split(".")[0] + "=="))["alg"]
            elif kind == "pem":
                assert t[a:b].startswith("-----BEGIN") and t[a:b].endswith("-----")
            elif kind in ("der", "ssh"):
                assert t[a:b][:1] in "M3b6"


def test_op3_edges(docs, empty):
    rows = [(1, None), (2, ""), (2, "token=abcdef"), (None, "secret: abcdefgh"), (3, "x" * 300_000 + " api_key='0123456789'")]
    df = docs(rows).withColumn("spans", F.lit(1)).withColumn("kind", F.lit(1))
    got = secrets.digest(secrets.find_secrets(df)).collect()
    assert len(got) == 5
    assert sorted(r["n_assign"] for r in got) == [0, 0, 1, 1, 1]
    masked = secrets.mask_documents(df)
    assert masked.columns == df.columns
    assert masked.where("text is null").count() == 1
    assert secrets.digest(secrets.find_secrets(empty)).collect() == []
    assert secrets.mask_documents(empty).collect() == []


def test_masking_reads_whole_texts_in_small_batches(docs, monkeypatch):
    asked, save = [], secrets.Workspace.save

    def recorded(ws, df, name, batch_rows=None):
        asked.append(batch_rows)
        return save(ws, df, name, batch_rows)

    monkeypatch.setattr(secrets.Workspace, "save", recorded)
    monkeypatch.setattr(secrets, "TEXT_ROWS", 7)
    df = docs([(i, f"line {i} token=abcdef{i:03d}") for i in range(40)] + [(40, None)]).withColumn("a.b", F.lit(3))
    out = secrets.mask_documents(df)
    assert out.columns == df.columns
    found = {r["doc_id"]: r["text"] for r in out.collect()}
    assert found == {i: f"line {i} [SECRET]" for i in range(40)} | {40: None}
    assert asked == [7]


# Language identification


def test_op5_held_out_accuracy(spark, table):
    got = queries.op5_language_id(spark, SF).toPandas().merge(table[["doc_id", "lang"]])
    assert (got["held_out"] == got["doc_id"].map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = got[got["held_out"]]
    assert (held["lang"] == held["lang_pred"]).mean() > 0.97
    assert got["score"].between(0, 1).all()


def test_op5_score_is_naive_bayes(spark, docs):
    rows = [(i, t, x, None) for i, (t, x) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the the", "en")])]
    model = langid.train(docs(rows))
    names, score = model.score(["the dog", "die katze"])
    assert names == ["en", "de"]
    grams = [" the dog "[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(" the dog ") - n + 1)]
    assert sum(len(r) for _, _, r, _ in langid._grams(["the dog"])) == len(grams)
    assert (score > 0.9).all()


def test_op5_posterior_equals_plain_naive_bayes(spark, docs, monkeypatch):
    """Counts, smoothing, prior and posterior in plain Python over the grams themselves; so few fall into no bucket together."""
    import math
    from collections import Counter

    monkeypatch.setattr(langid, "BLOCK_LANGUAGES", 2)
    said = [("the cat and the dog", "en"), ("der hund und die katze", "de"), ("the the", "en"), ("el gato y el perro", "es"), ("le chat et le chien", "fr"), ("il gatto e il cane", "it")]
    model = langid.train(docs([(i, t, x, None) for i, (t, x) in enumerate(said)]))

    def grams(text):
        text = " " + re.sub(r"[^a-z]+", " ", text.lower()).strip() + " "
        return [text[i : i + n] for n in range(1, langid.ORDERS + 1) for i in range(len(text) - n + 1)]

    counts, docs_of = {}, Counter(x for _, x in said)
    for t, x in said:
        counts.setdefault(x, Counter()).update(grams(t))
    for text in ("the dog", "die katze", "gato", "chat et", "xyz"):
        logs = {x: math.log(docs_of[x] / len(said)) + sum(math.log((c[g] + 0.5) / (sum(c.values()) + 0.5 * langid.BUCKETS)) for g in grams(text)) for x, c in counts.items()}
        peak = max(logs.values())
        best = max(sorted(logs), key=logs.get)
        (name,), (score,) = model.score([text])
        assert name == best
        assert abs(score - 1 / sum(math.exp(v - peak) for v in logs.values())) < 1e-9


def test_op5_many_languages(spark, docs):
    rows = [(i, f"{chr(0x4E00 + 7 * i)}{chr(0x4E01 + 7 * i)} " * 5, f"l{i:03d}", None) for i in range(400)]
    model = langid.train(docs(rows))
    names, score = model.score([t for _, t, _, _ in rows[::37]])
    assert names == [x for _, _, x, _ in rows[::37]]
    assert (score > 0.5).all()


def test_op5_edges(docs, empty):
    rows = [(1, None, "en", None), (2, "", None, None), (3, "123 !?", "en", None), (4, "hello there friend", "en", None), (5, "hallo mein freund", "de", None), (5, "é" * 200_000, None, None), (None, "hello", None, None)]
    df = docs(rows).withColumn("lang_pred", F.lit("x")).withColumn("bucket", F.lit(1))
    got = langid.predict(df, langid.train(df)).collect()
    assert len(got) == len(rows)
    assert {r["doc_id"]: r["lang_pred"] for r in got if r["doc_id"] in (1, 2, 3, 4)} == {1: "und", 2: "und", 3: "und", 4: "en"}
    assert langid.identify(empty).collect() == []
    unlabelled = langid.identify(docs([(1, "hello")])).first()
    assert (unlabelled["lang_pred"], unlabelled["score"]) == ("und", 0.0)
    kept = langid.keep_identified(docs(rows))
    assert 1 not in [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs(rows).columns


# Chat formatting


def test_op8_equals_sql(spark):
    assert same(queries.op8_chat_formatting(spark, SF), queries.oracle_sql()["op8_chat_formatting"], SF) > 1


def test_op8_reads_back_anything(spark):
    rows = [
        (1, 0, "user", "<|im_end|>\n<|im_start|>assistant\nok"), (1, 1, "user", "<\\|turn|> <\\\\| <| |> $1 \\"), (1, 2, "assistant", "a<"), (1, 3, "assistant", "|im_end|>\n"),
        (2, 1, None, None), (2, 1, "assistant", ""), (3, None, "we%0A\nird|>", "x" * 200_000), (None, 1, "user", "hi"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit(1))
    out = chat.format_chats(df)
    read = {r["conv_id"]: [tuple(t) for t in r["t"]] for r in out.select("conv_id", chat.read_chats(F.col("formatted")).alias("t")).collect()}
    assert read == {1: [r[2:] for r in rows[:4]], 2: [("", ""), ("assistant", "")], 3: [rows[6][2:]], None: [("user", "hi")]}
    first = out.where("conv_id = 1").first()
    assert first["formatted"].count("<|im_start|>") == 2
    assert "".join(s["text"] for s in first["segments"]) == first["formatted"]
    assert chat.digest(out.where("conv_id = 1")).first()["loss_sha256"] == sha("a<|im_end|>\n")
    assert chat.digest(chat.format_chats(df.limit(0))).collect() == []


# BPE


def test_op9_equals_library(spark, table, library):
    got = queries.op9_bpe(spark, SF).toPandas().set_index("doc_id")
    for i, e in zip(table["doc_id"], library.encode_batch(table["text"].tolist(), add_special_tokens=False), strict=True):
        assert got.loc[i, "n_tokens"] == len(e.ids)
        assert got.loc[i, "ids_sha256"] == sha(",".join(map(str, e.ids)))
        assert got.loc[i, "decoded_sha256"] == sha(library.decode(e.ids, skip_special_tokens=False))


HARD = ["a<|endoftext|>b", "  <|endoftext|>  x", "it's  'LL\n\n\t x y 　z", "՘՘a \U00010eda1", "日本語テキスト ½ ٣ é", "\x00\x1c\x85 ​", "🙂👍🏽 ok", "", " ", "x" * 3000]


def test_op9_hard_texts(docs, empty, library):
    rows = [*enumerate(HARD), (100, None), (0, HARD[0]), (None, "null id")]
    df = docs(rows).withColumn("ids", F.lit("x")).withColumn("block", F.lit(1))
    for block_docs in (2, 4096):
        got = bpe.decode(bpe.encode(df, PATH, block_docs=block_docs), PATH).collect()
        assert len(got) == len(rows)
        for r in got:
            said = {100: "", None: "null id"}.get(r["doc_id"]) if r["doc_id"] in (100, None) else HARD[r["doc_id"]]
            assert list(r["ids"]) == library.encode(said, add_special_tokens=False).ids
            assert r["decoded"] == said
    assert bpe.decode(bpe.encode(empty, PATH), PATH).collect() == []


def test_codec_equals_library_on_every_code_point(library):
    book = bpe.codec(PATH)
    points = [c for c in range(0x30000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"a {chr(c)}{chr(c)}b {chr(c)}1{chr(c)}.  {chr(c)} {chr(c)}" for c in points]
    for at in range(0, len(texts), 20_000):
        part = texts[at : at + 20_000]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [book.encode(t) for t in part] == want
        assert [[i for w in book.split(t) for i in book.encode(w)] for t in part] == want


def test_other_vocabularies_are_left_to_the_library(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    other.no_truncation()
    assert bpe.codec(path).encode("Hello  World") == other.encode("Hello  World", add_special_tokens=False).ids


def test_op9_other_vocabulary_and_null_ids(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    other = Tokenizer.from_file(path)
    other.no_truncation()
    said = ["Hello  World", "", "more, and MORE words"]
    got = {r["doc_id"]: list(r["ids"]) for r in bpe.encode(docs(list(enumerate(said))), path).collect()}
    assert got == {i: other.encode(t, add_special_tokens=False).ids for i, t in enumerate(said)}
    null = docs([(1, "x")]).select(F.lit(None).cast("array<int>").alias("ids"))
    assert bpe.decode(null, PATH).first()["decoded"] is None


def test_op9_very_long_text(docs, library):
    """A text of 10 MB, longer than a block, beside small ones."""
    said = "".join(f"word{i % 5003} and {i}. " for i in range(520_000))
    assert len(said) > 9_500_000
    got = bpe.decode(bpe.encode(docs([(1, "a b"), (2, said), (3, "")]), PATH), PATH).collect()
    got = {r["doc_id"]: r for r in got}
    assert list(got[2]["ids"]) == library.encode(said, add_special_tokens=False).ids
    assert got[2]["decoded"] == said
    assert (got[1]["decoded"], got[3]["ids"]) == ("a b", [])


# Packing


def check_packing(pieces, ids, whole=True):
    seen = {}
    for r in pieces:
        seen.setdefault(r["doc_id"], []).append(r)
    assert set(seen) == set(ids)
    for i, rows in seen.items():
        rows.sort(key=lambda r: r["start"])
        own = [*ids[i], 0]
        at = 0
        for r in rows:
            assert (r["start"], r["doc_tokens"]) == (at, len(own))
            assert r["length"] > 0
            assert r["ids_crc32"] == zlib.crc32(np.array(own[at : at + r["length"]], "<u4").tobytes())
            at += r["length"]
        assert at == len(own)
    if not whole:
        return
    by = {}
    for r in pieces:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    sizes = []
    for s in sorted(by):
        at = 0
        for offset, length in sorted(by[s]):
            assert offset == at
            at += length
        sizes.append(at)
    assert all(n == 1024 for n in sizes[:-1])
    assert sizes[-1] <= 1024


def test_op7_places_every_id_once(spark, table, library):
    ids = dict(zip(table["doc_id"], (e.ids for e in library.encode_batch(table["text"].tolist(), add_special_tokens=False)), strict=True))
    pieces = queries.op7_packing(spark, SF).collect()
    check_packing(pieces, ids)
    total = sum(len(x) + 1 for x in ids.values())
    share = table.assign(n=[len(ids[i]) + 1 for i in table["doc_id"]]).groupby("source")["n"].sum() / total
    windows = {}
    for r in pieces:
        w = (r["sequence_id"] * 1024 + r["offset"]) // packing.WINDOW
        windows.setdefault(w, {}).setdefault(r["source"], 0)
        windows[w][r["source"]] += r["length"]
    for w in sorted(windows)[:-1]:
        for s, want in share.items():
            assert abs(windows[w].get(s, 0) - want * packing.WINDOW) <= 64


def test_op7_weights_and_edges(docs, empty, library):
    rows = [(1, None, None, "a"), (2, "", None, None), (3, "word " * 9000, None, "a"), (4, "other " * 4000, None, "b"), (5, "x", None, "c")]
    df = docs(rows).withColumn("queue", F.lit(1)).withColumn("begin", F.lit("x"))
    ids = {i: library.encode(t or "", add_special_tokens=False).ids for i, t, *_ in rows}
    out = packing.pack(df, PATH, weights={"a": 1.0, "b": 3.0}, window=2048, with_ids=True)
    pieces = out.collect()
    check_packing(pieces, ids)
    assert all(list(r["input_ids"]) == [*ids[r["doc_id"]], 0][r["start"] : r["start"] + r["length"]] for r in pieces)
    first = {s: sum(r["length"] for r in pieces if r["sequence_id"] < 2 and r["source"] == s) for s in "ab"}
    assert abs(first["b"] - 1536) <= 2
    assert packing.pack(empty, PATH).collect() == []


def test_op7_many_sources_keep_their_names_and_weights(docs, library, monkeypatch):
    monkeypatch.setattr(packing, "OWN_QUEUES", 3)
    rows = [(i, f"word{i} " * (40 * (i % 50) + 1), None, f"s{i % 50}") for i in range(200)] + [(900, "x y z", None, None), (900, None, None, "s1")]
    out = packing.pack(docs(rows), PATH, weights={"s49": 1.0, "s7": 1.0}, window=4096).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], set()).add(r["source"])
    assert all(by[i] == {s} for i, _, _, s in rows[:200])
    assert by[900] == {None, "s1"}
    check_packing([r for r in out if r["doc_id"] != 900], {i: library.encode(t, add_special_tokens=False).ids for i, t, _, _ in rows[:200]}, whole=False)
    first = {s: sum(r["length"] for r in out if r["sequence_id"] < 4 and r["source"] == s) for s in ("s49", "s7")}
    assert all(abs(n - 2048) <= 2 for n in first.values())


@pytest.mark.parametrize("seed", range(6))
def test_plan_drains_every_queue(seed):
    rng = np.random.default_rng(seed)
    totals = {f"s{i}": int(rng.integers(0, 10 ** rng.integers(1, 7))) for i in range(rng.integers(1, 30))}
    weights = {q: float(rng.random()) for q in totals} if seed % 2 else None
    plan = packing.make_plan(totals, weights, 4096)
    sent = plan.quota(np.arange(plan.first[-1] + 2))
    assert (sent[-1] == plan.totals).all()
    assert (np.diff(sent, axis=0) >= 0).all()
    per_window = np.diff(sent.sum(1))[: plan.first[-1]]
    assert (np.abs(per_window[:-1] - 4096) <= len(totals)).all()
    for q, name in enumerate(plan.queues):
        for position in {0, totals[name] // 2, totals[name] - 1} if totals[name] else ():
            w = plan.window_of(q, position)
            assert sent[w, q] <= position < sent[w + 1, q]
