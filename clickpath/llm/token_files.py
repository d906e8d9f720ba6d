"""Token ids in files: a shared Zstandard dictionary, one frame per document, an offset index.

Documents lie in ascending doc_id order over all files. A file names the
dictionary by its hash and lists where each document's frame lies, so a reader
that holds the dictionary unpacks a short document without its neighbours.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, functions as F

from clickpath.llm.common import whole_text
from clickpath.runtime import stored

# Fixed values of the format: magic, version; then bytes of an id, documents, ids before the file in its part
MAGIC, VERSION = b"TIDZ", 1
HEAD = struct.Struct("<4sHHQQ32s")
#: An index entry: doc_id, whether it is null, end of the frame in the body, number of ids
ENTRY = np.dtype([("doc_id", "<i8"), ("null", "u1"), ("end", "<u8"), ("n", "<u8")])

KNOWN_WORDS, KNOWN_BYTES = 800_000, 32 << 20  # what an encoder remembers at most
TEXTS_AT_ONCE = 1 << 24  # characters whose words are looked up together


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: A plain word: printable ASCII without apostrophes (clitics) and < (special tokens), Latin letters; and its runs.
_PLAIN = "^[!-&(-;=-~À-ÖØ-öø-įı-ſ]+$"
_RUNS = "([A-Za-zÀ-ÖØ-öø-ſ]+|[0-9]|[^A-Za-zÀ-ÖØ-öø-ſ0-9]+)"
#: Words on which a tokenizer shows whether it parts plain words so.
PROBES = ("ab,cd", "x--y", "a1b22", "###", "end.", "(Word)", "a_b", "50%", "q...", "e-mail", "7th", "Ab$$$", "**X**",
          "3.14", "[ok]", "THE", "a@b.org", "~`^", "x=y;z", "C++", "2024-01-31", "élève", "ÉTÉ!", "größe", "Œuvre", "ŠKODA")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level models write for a byte from 128 on: printable ones themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    letters = {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return {b: letters[b] for b in range(128, 256)}


_LETTERS = _byte_letters()


class _Ragged:
    """Id arrays one after the other: array k is ``ids[ends[k]:ends[k + 1]]``."""

    def __init__(self, kind: np.dtype):
        self.ids, self.ends = np.empty(0, kind), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, each: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(each)])

    def take(self, at: np.ndarray, block: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends from 0 on) of the arrays at these places, in their order."""
        length = self.ends[at + 1] - self.ends[at]
        through = np.r_[0, np.cumsum(length)]
        out = np.empty(int(through[-1]), self.ids.dtype)
        for a in range(0, len(at), block):
            z = min(a + block, len(at))
            first, last = int(through[a]), int(through[z])
            out[first:last] = self.ids[np.repeat(self.ends[at[a:z]] - through[a:z], length[a:z]) + np.arange(first, last)]
        return out, through


class _Known(_Ragged):
    """Strings whose ids are remembered; ``ask`` gives (ids, their number for each) of new ones."""

    def __init__(self, kind: np.dtype, ask: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]):
        super().__init__(kind)
        self.ask, self.places, self.held = ask, {}, 0

    def find(self, strings: pa.Array) -> np.ndarray:
        """The places of different strings."""
        keys = strings.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.places.get, keys, itertools.repeat(-1)), np.int64, len(keys))
        new = np.flatnonzero(place < 0)
        if len(new):
            self.add(*self.ask(strings.take(pa.array(new))))
            place[new] = np.arange(len(self.places), len(self.places) + len(new))
            names = [keys[i] for i in new.tolist()]
            self.places.update(zip(names, place[new].tolist()))
            self.held += sum(map(len, names))
        return place


class Encoder:
    """Ids of texts, as arrays.

    ``by_word`` holds for tokenizers that drop white space and never look
    across it: each different word of a group of texts is then encoded once. If
    the tokenizer parts plain words into runs of letters, single digits and runs
    of other characters, which PROBES show, runs go straight to its model. Runs
    and words that are not plain are remembered.
    """

    def __init__(self, path: str, by_word: bool = True):
        self.tokenizer, self.by_word = _tokenizer(path), by_word
        self.width = 2 if self.tokenizer.get_vocab_size() <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.width}")
        whole = self._whole(list(PROBES))
        self._forget()
        self.fold = next((fold for fold in (str.lower, str) if whole == [
            ids.tolist() for ids in self._parted(*self._of_plain(pa.array(PROBES, pa.large_string()), fold))]), None)
        self._forget()

    def _forget(self) -> None:
        self.runs, self.others = _Known(self.kind, self._of_runs), _Known(self.kind, self._of_others)

    def _whole(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    @staticmethod
    def _parted(ids: np.ndarray, through: np.ndarray) -> list[np.ndarray]:
        return np.split(ids, through[1:-1])

    def _of_others(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._whole(words.to_pylist())
        each = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(itertools.chain.from_iterable(found), self.kind, int(each.sum())), each

    def _of_runs(self, runs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Runs by the model alone, which sees the letters of their bytes."""
        model, ids, each = self.tokenizer.model, [], []
        for run in runs.to_numpy(zero_copy_only=False).tolist():
            if not run.isascii():
                run = run.encode().decode("latin-1").translate(_LETTERS)
            own = [t.id for t in model.tokenize(run)]
            ids += own
            each.append(len(own))
        return np.array(ids, self.kind), np.array(each, np.int64)

    def _of_plain(self, words: pa.Array, fold: Callable[[str], str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends from 0 on) of plain words from those of their runs."""
        folded = pc.utf8_lower(words) if fold is str.lower else words
        marked = pc.replace_substring_regex(folded, _RUNS, "\\1\n")
        parts = pc.split_pattern(pc.utf8_rtrim(marked, "\n"), "\n")
        coded = parts.flatten().dictionary_encode()
        ids, through = self.runs.take(self.runs.find(coded.dictionary)[coded.indices.to_numpy()])
        return ids, through[parts.offsets.to_numpy()]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if not self.by_word:
            return [np.array(ids, self.kind) for ids in self._whole(texts)]
        known = self.runs, self.others
        if sum(len(k.places) for k in known) > KNOWN_WORDS or sum(k.held for k in known) > KNOWN_BYTES:
            self._forget()
        # the words between blanks, tabs and line ends of ASCII, which any such tokenizer parts at
        split = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary
        plain = pc.match_substring_regex(words, _PLAIN) if self.fold else pa.array(np.zeros(len(words), bool))
        found = _Ragged(self.kind)  # plain words first
        if pc.any(plain).as_py():
            ids, through = self._of_plain(words.filter(plain), self.fold)
            found.add(ids, np.diff(through))
        ids, through = self.others.take(self.others.find(words.filter(pc.invert(plain))))
        found.add(ids, np.diff(through))
        place = np.empty(len(words), np.int64)
        place[np.argsort(~plain.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(words))
        flat, through = found.take(place[coded.indices.to_numpy()])
        return self._parted(flat, through[split.offsets.to_numpy()])


@functools.lru_cache(maxsize=2)
def encoder_of(path: str, by_word: bool) -> Encoder:
    """One encoder a worker, which goes on with what it remembers in its next task."""
    return Encoder(path, by_word)


def _texts_at_once(texts: pa.Array, most: int = TEXTS_AT_ONCE) -> Iterator[tuple[int, list[str]]]:
    """(place of the first, texts) in groups of about ``most`` characters."""
    group, size, first = [], 0, 0
    for i, text in enumerate(texts):
        group.append(text.as_py())
        size += len(group[-1])
        if size >= most:
            yield first, group
            group, size, first = [], 0, i + 1
    if group:
        yield first, group


def train_dictionary(docs: DataFrame, tokenizer: str, by_word: bool = True, sample_docs: int = 2_000,
                     slice_ids: int = 4_096, dictionary_bytes: int = 64 << 10, seed: int = 1) -> bytes:
    """A dictionary from the id arrays of a random sample, about ``sample_docs`` rows of any place in the table.

    Of a long document one run of ``slice_ids`` ids counts. The sample only
    decides how well the files compress, never what they hold. Too few or too
    equal rows to train on give no dictionary (no bytes).
    """
    share = min(1.0, sample_docs / max(docs.count(), 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, by_word)
        for batch in batches:
            for _, texts in _texts_at_once(batch.column("text")):
                out = []
                for ids in encoder.encode(texts):
                    at = int(ids.sum(dtype=np.int64)) % max(1, len(ids) - slice_ids + 1)
                    out.append(ids[at:at + slice_ids].tobytes())
                yield pa.RecordBatch.from_pydict({"ids": pa.array(out, pa.binary())})

    drawn = docs.select(whole_text().alias("text")).sample(share, seed)
    samples = [bytes(r.ids) for r in drawn.mapInArrow(run, "ids binary").collect() if len(r.ids) >= 8]
    try:
        size = min(dictionary_bytes, max(256, sum(map(len, samples)) // 8))
        return zstandard.train_dictionary(size, samples, k=256, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _loaded(dictionary: bytes):
    return zstandard.ZstdCompressionDict(dictionary) if dictionary else None


def pack(docs: list[tuple[int | None, bytes]], dictionary: bytes, width: int, before: int = 0, level: int = 3) -> bytes:
    """A file of (doc_id, serialised ids), each compressed apart; ``before``: ids before it in its part."""
    writer = zstandard.ZstdCompressor(level=level, dict_data=_loaded(dictionary))
    frames = [writer.compress(data) for _, data in docs]
    index = np.zeros(len(docs), ENTRY)
    index["doc_id"] = [doc_id or 0 for doc_id, _ in docs]
    index["null"] = [doc_id is None for doc_id, _ in docs]
    index["end"] = np.cumsum([len(f) for f in frames])
    index["n"] = [len(data) // width for _, data in docs]
    head = HEAD.pack(MAGIC, VERSION, width, len(docs), before, hashlib.sha256(dictionary).digest())
    return head + index.tobytes() + b"".join(frames)


class TokenFile:
    """A file opened with its dictionary: ``index``, ``before`` and single documents' ids."""

    def __init__(self, data: bytes, dictionary: bytes):
        magic, version, self.width, count, self.before, named = HEAD.unpack_from(data)
        if (magic, version) != (MAGIC, VERSION):
            raise ValueError("not a token file of this version")
        if named != hashlib.sha256(dictionary).digest():
            raise ValueError(f"the file needs the dictionary {named.hex()}")
        self.index = np.frombuffer(data, ENTRY, count, HEAD.size)
        self.body = memoryview(data)[HEAD.size + self.index.nbytes:]
        self.reader = zstandard.ZstdDecompressor(dict_data=_loaded(dictionary))

    def __len__(self) -> int:
        return len(self.index)

    def ids(self, k: int) -> np.ndarray:
        """The ids of the k-th document; no other frame is read."""
        frame = self.body[int(self.index["end"][k - 1]) if k else 0:int(self.index["end"][k])]
        return np.frombuffer(self.reader.decompress(frame), f"<u{self.width}")


FILE_SCHEMA = "part int, seq long, n_docs long, n_ids long, body binary"


def write(docs: DataFrame, tokenizer: str, dictionary: bytes, end_id: int = 2, by_word: bool = True,
          file_bytes: int = 4 << 20, level: int = 3) -> DataFrame:
    """(part, seq, n_docs, n_ids, body): the files of a table (doc_id, text), for ``stored`` or ``export``.

    Every row's whole text (null: empty) is encoded without special tokens and
    closed by ``end_id``. Rows lie by doc_id, null first, rows that repeat a
    doc_id by a hash of their text; (part, seq) is the order of the files. A
    file ends after ``file_bytes`` of serialised ids, so a task holds one file
    at a time. Rows are range-sorted, and rows alike may lie in several parts.
    An empty table gives no file.
    """
    text = whole_text()
    rows = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("_hash"),
                       F.monotonically_increasing_id().alias("_row"))
    order = ["doc_id", "_hash", "text"]
    placed = (rows.repartitionByRange("doc_id", "_hash", "_row").sortWithinPartitions(*order)
              .select("doc_id", "text", F.spark_partition_id().alias("part")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer, by_word)
        held: list[tuple[int | None, bytes]] = []
        size, before, seq, part = 0, 0, 0, 0

        def out() -> pa.RecordBatch:
            body = pack(held, dictionary, encoder.width, before, level)
            row = (part, seq, len(held), size // encoder.width, body)
            return pa.RecordBatch.from_pydict({
                name: pa.array([v], kind) for name, v, kind in zip(
                    ("part", "seq", "n_docs", "n_ids", "body"), row,
                    (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))})

        end = np.array([end_id], encoder.kind)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            if len(batch):
                part = batch.column("part")[0].as_py()
            for first, texts in _texts_at_once(batch.column("text")):
                for i, ids in enumerate(encoder.encode(texts), first):
                    held.append((doc_ids[i].as_py(), np.concatenate([ids, end]).tobytes()))
                    size += len(held[-1][1])
                    if size >= file_bytes:
                        yield out()
                        before, seq = before + size // encoder.width, seq + 1
                        held, size = [], 0
        if held:
            yield out()

    return placed.mapInArrow(run, FILE_SCHEMA)


def read(files: DataFrame, dictionary: bytes) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32: a row per document, from the files.

    ``start`` counts the ids of all documents before it; ``ids_crc32`` is the
    CRC-32 of its ids as little-endian 32-bit numbers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, body in zip(batch.column("part"), batch.column("body")):
                file = TokenFile(body.as_py(), dictionary)
                n = file.index["n"].astype(np.int64)
                crc = [zlib.crc32(file.ids(k).astype("<u4").tobytes()) for k in range(len(file))]
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array([part.as_py()] * len(file), pa.int32()),
                    "doc_id": pa.array(file.index["doc_id"], pa.int64(), mask=file.index["null"].astype(bool)),
                    "own_start": pa.array(file.before + np.cumsum(n) - n, pa.int64()),
                    "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(crc, pa.int64())})

    return (files.select("part", "body")
            .mapInArrow(run, "part int, doc_id long, own_start long, n_tokens long, ids_crc32 long")
            .join(F.broadcast(part_starts(files)), "part")  # one row per part
            .select("doc_id", (F.col("own_start") + F.col("_before")).alias("start"), "n_tokens", "ids_crc32"))


def part_starts(files: DataFrame) -> DataFrame:
    """(part, _before): ids in all parts before each; a row per range partition of the writer."""
    sizes = files.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()
    rows, before = [], 0
    for part, n in sorted(tuple(r) for r in sizes):
        rows.append((part, before))
        before += n
    return files.sparkSession.createDataFrame(rows, "part int, _before long")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 2, by_word: bool = True) -> tuple[DataFrame, bytes]:
    """The stored files of a table and the dictionary that they share."""
    docs = docs.select("doc_id", "text")
    dictionary = train_dictionary(docs, tokenizer, by_word)
    return stored(write(docs, tokenizer, dictionary, end_id, by_word), "token-files"), dictionary


def export(files: DataFrame, dictionary: bytes, folder: str) -> None:
    """Write the files and their dictionary to a mounted folder that all executors share.

    A file is named by its place, the dictionary by its hash; each is moved into
    place when complete, so repeated task attempts leave the same files.
    """

    def put(name: str, data: bytes) -> None:
        path = os.path.join(folder, name)
        with open(f"{path}.part-{os.getpid()}", "wb") as file:
            file.write(data)
        os.replace(f"{path}.part-{os.getpid()}", path)

    def run(rows: Iterator) -> None:
        for row in rows:
            put(f"{row.part:08d}-{row.seq:08d}.ids", bytes(row.body))
        put(f"{hashlib.sha256(dictionary).hexdigest()}.dict", dictionary)

    files.foreachPartition(run)
