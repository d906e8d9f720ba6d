"""The prefix trie, the token files and the Merkle manifest against plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from clickpath.llm import merkle, radix_trie, token_files

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# the prefix trie

def brute_trie(rows):
    by = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            by.setdefault(c, []).append((turn is not None, turn or 0, tie, role, text))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in by.items()}
    full = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        full[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    members = {}
    for c, turns in full.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(members[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    out = []
    for p, m in members.items():
        ends = ",".join(map(str, sorted(c for c in m if len(full[c]) == len(p))))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("key_bytes", [8 << 20, 3_000, 300])
def test_trie_by_brute_force(spark, key_bytes):
    """Whatever the ranges: a common first turn, whole copies, turnless and null ones."""
    rows = [(c, t, "user", "hi there") for c in range(300, 380) for t in range(1 + c % 6)]
    rows += [(c, t, "user", f"deep {t} of many words") for c in range(400, 410) for t in range(30)]
    rows += [(None, 1, "a", "b"), (200, None, None, None), (200, 1, "user", "x y"), (201, 0, "u", "only"),
             (202, 0, "u", "p"), (202, 1, "u", "q"), (202, 2, "u", "r" * 9000), (202, 2, "u", "r"), (202, 2, "u", "r")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    given = spark.read.parquet(f"{SF}/conversations.parquet").select(frame.columns)
    turns = given.union(frame).withColumn("key", F.lit("clash")).withColumn("n_convs", F.lit(1))
    found = radix_trie.prefix_trie(turns, key_bytes=key_bytes)
    assert found.columns == radix_trie.COLUMNS
    want = brute_trie([tuple(r) for r in given.union(frame).collect()])
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    assert radix_trie.prefix_trie(turns.limit(0)).collect() == []


def test_layouts_grow():
    draw = random.Random(1)
    keys = sorted({bytes([draw.randrange(256)]) + bytes(15) + b"".join(
        bytes([draw.randrange(3)]) * 16 for _ in range(draw.randrange(5))) for _ in range(900)})
    root = radix_trie.Branch(keys[0], 0, len(keys[0]))
    for i, key in enumerate(keys):
        radix_trie.insert(root, key, i)
    assert root.layout == 256 and {radix_trie.Branch, type(None)} == {type(w) for w in root.ways} | {type(None)}
    found = radix_trie.nodes(keys, list(range(len(keys))))
    prefixes = {k[:16 * d] for k in keys for d in range(len(k) // 16 + 1)}
    assert len(found) == len(prefixes)
    whole = next(n for n in found if n[radix_trie.DEPTH] == 0)
    assert whole[radix_trie.CONVS] == len(keys) and whole[radix_trie.CHILDREN] == len({k[:16] for k in keys if k})
    sizes = {n: radix_trie.Branch(b"", 0, 0) for n in (3, 5, 20, 60)}
    for n, branch in sizes.items():
        for byte in draw.sample(range(256), n):
            branch.add(byte, radix_trie.Branch(bytes([byte]), 0, 1))
        assert [b.key[0] for b in branch.branches()] == sorted(b.key[0] for b in branch.branches()) or n == 20
        assert all(branch.way(b.key[0]) is b for b in branch.branches())
    assert [b.layout for b in sizes.values()] == [4, 16, 48, 256]


# token files

def test_token_files_round_trip(spark, tmp_path):
    rows = [(None, "a"), (None, None), (5000, "a b"), (5000, ""), (5000, ""), (5001, "long " * 60_000),
            (5002, "<|endoftext|> x\x1cy z \u00c5\u00c9 don't \x0b12 34 <|startoftext|>"), (-3, "\u00e9 \u0301 \u03a3\u03b1\u03c2")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame(rows, docs.schema)).repartition(3)
    clashing = docs.withColumn("part", F.lit("x")).withColumn("body", F.lit(1))
    files, dictionary = token_files.token_files(clashing, WORDS)
    found = sorted(token_files.read(files, dictionary).collect(), key=lambda r: r.start)
    given = [tuple(r) for r in docs.collect()]
    ids = [e.ids + [2] for e in Tokenizer.from_file(WORDS).encode_batch([t or "" for _, t in given], add_special_tokens=False)]
    want = Counter((i, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (i, _), x in zip(given, ids))
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == want
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]
    order = [(r.doc_id is not None, r.doc_id or 0) for r in found]
    assert order == sorted(order)
    token_files.export(files, dictionary, str(tmp_path))
    paths = sorted(tmp_path.glob("*.ids"))
    kept = next(tmp_path.glob("*.dict")).read_bytes()
    assert len(paths) == files.count() and hashlib.sha256(kept).hexdigest() == next(tmp_path.glob("*.dict")).stem
    file = token_files.TokenFile(paths[0].read_bytes(), kept)
    assert file.index["n"][0] == len(file.ids(0)) and file.ids(len(file) - 1)[-1] == 2
    with pytest.raises(ValueError):
        token_files.TokenFile(paths[0].read_bytes(), b"other")
    empty, none = token_files.token_files(docs.limit(0), WORDS)
    assert token_files.read(empty, none).collect() == []


def test_many_small_files_keep_the_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").repartition(7)
    files = token_files.write(docs, WORDS, b"", file_bytes=3_000).cache()
    assert files.count() > 20
    found = sorted(token_files.read(files, b"").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted(r.doc_id for r in found)
    assert [r.start for r in found] == [0, *np.cumsum([r.n_tokens for r in found])[:-1]]


def test_words_and_runs_give_the_tokenizer_s_ids():
    draw = random.Random(3)
    letters = [chr(c) for c in (*range(33, 127), *range(0xC0, 0x180))] + list("'<>|\u0301\u01c5\u00df\u212a") + ["abc", "the"]
    texts = [" ".join("".join(draw.choice(letters) for _ in range(draw.randrange(1, 9))) for _ in range(80)) for _ in range(200)]
    encoder = token_files.Encoder(WORDS)
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert encoder.fold is str.lower and [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in token_files.Encoder(WORDS, by_word=False).encode(texts)] == want


def test_a_worker_asks_the_model_once_for_each_run(monkeypatch):
    encoder, asked = token_files.encoder_of(WORDS, True), []
    assert token_files.encoder_of(WORDS, True) is encoder
    encoder._forget()
    for known in (encoder.runs, encoder.others):
        monkeypatch.setattr(known, "ask", lambda new, ask=known.ask: (asked.extend(new.to_pylist()), ask(new))[1])
    first = ["Zorbly, zorbly. zorbly!! it's", "", " \t zorbly\x1c9\x0b\n", "it's \u0416\u0438"]
    texts = first + ["QUIX;zorbly 77", "it's"]
    got = encoder.encode(first) + encoder.encode(texts[len(first):])
    assert [x.tolist() for x in got] == [
        e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(asked) == len(set(asked)) and {"zorbly", "quix", "it's"} <= set(asked)


def test_every_plain_letter_and_empty_texts():
    encoder = token_files.Encoder(WORDS)
    letters = [chr(c) for c in (*range(33, 127), *range(0xA0, 0x250))]
    texts = [" ".join((c, c * 3, f"a{c}", f"{c}b7", f"x{c}{c}.")) for c in letters]
    assert [x.tolist() for x in encoder.encode(texts)] == [
        e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [len(x) for x in encoder.encode(["", " "])] == [0, 0]


# the manifest

def brute_manifest(rows):
    def digest(text):
        return hashlib.sha256(text.encode()).hexdigest()

    def leaf(row, text):
        return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)))

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([digest("".join(out[-1][i:i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    of_source = {}
    for row in rows:
        of_source.setdefault(row[1], []).append(row)
    names = sorted(of_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for own in of_source.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        trees[own[0][1]] = levels([leaf(r, r[4]) for r in own])
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for k, row in enumerate(of_source[s]):
            text = row[4]
            if text is not None and row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0:
                text = text.replace("\n", "")
            folded, proof = leaf(row, text), ""
            for tree, i in ((trees[s], k), (top, names.index(s))):
                for level in tree[:-1]:
                    run = level[i // 3 * 3:i // 3 * 3 + 3]
                    proof += "".join(run[:i % 3] + run[i % 3 + 1:])
                    run[i % 3] = folded
                    folded, i = digest("".join(run)), i // 3
            out.append((row[0], leaf(row, row[4]), trees[s][-1][0], top[-1][0], digest(proof), folded, folded == top[-1][0]))
    return sorted(map(repr, out))


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def test_manifest_by_brute_force(spark):
    rows = [(None, "a", "b", None, None), (None, "a", "b", None, None), (5, "a", "b", None, None), (5, "s", None, 3, ""),
            (5, "s", None, 3, ""), (2, None, None, 3, "x\ny"), (8, "\u00e9", None, 3, "x\ny" * 50_000), (9, "", "", 0, "")]
    given = spark.read.parquet(f"{SF}/documents.parquet").select(*FIELDS)
    docs = given.union(spark.createDataFrame(rows, given.schema))
    clashing = docs.withColumn("tree", F.lit("x")).withColumn("idx", F.lit("y"))
    found = merkle.manifest(clashing, merkle.tampered(clashing))
    got = sorted(repr(tuple(r)) for r in found.drop("steps").collect())
    assert got == brute_manifest([tuple(r) for r in docs.collect()])
    assert merkle.manifest(docs.limit(0)).collect() == []


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10, 28])
def test_manifest_sizes(spark, n):
    rows = [(i, "one" if i % 2 else "two", "en", i, f"text {i}\n") for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    plain = merkle.manifest(docs).collect()
    assert len(plain) == n and all(r.verified and r.folded_root == r.root for r in plain)
    got = sorted(repr(tuple(r)) for r in merkle.manifest(docs, merkle.tampered(docs)).drop("steps").collect())
    assert got == brute_manifest(rows)
