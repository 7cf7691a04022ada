"""BPE encoding through a table of distinct words, and decoding through a table of pieces."""

from __future__ import annotations

import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .samples import share_of
from .scratch import Scratch, only

#: Words whose ids every task gets: so many of at most so many bytes, the most frequent ones of a sample of so many
#: characters. Together they are a few dozen MB. Which words these are does not change a result.
TIERS, SAMPLE = ((262_144, 32), (2_048, 4_096), (16, 1 << 20)), 100_000_000
#: Distinct words, and characters of them, that a task counts before it passes them on.
COUNTED, COUNTED_CHARS = 150_000, 1 << 22
#: Bytes of a batch that a task gives at once.
BATCH_BYTES = 1 << 20


def default_tokenizer() -> str:
    """Path of the 49k word vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(
    df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text",
    tiers: tuple[tuple[int, int], ...] = TIERS, sample: int = SAMPLE, decode: bool = False,
) -> DataFrame:
    """The ids of whole texts: doc_id, ids (binary: little-endian unsigned 32-bit numbers), as the tokenizer of `path` gives them without special tokens.

    With `decode` also n_tokens and decoded, as `decode_documents` gives them.

    The tokenizer must drop white space, so that a text's ids are those of its
    words one after another; `Splitter` says what a word is. Each distinct word
    is encoded once, by the tokenizer itself, into a table, and ids go back to
    their positions by two joins: words that a sample shows to be frequent are
    encoded first and broadcast with their ids (`tiers` bound them, and any word
    in a large share of the rows is among them). All other words of a document,
    each once, are shuffled and sorted by word, so that the rows of a word meet
    its ids where these are made. Texts become numbers of words before they are
    shuffled to the ids of their other words.

    Null text: empty, no ids. Rows keep their number, repeated ones included;
    a null doc_id is one like another. Very long texts and words are whole.
    Empty table: no rows. Extra columns are ignored.
    """
    path = path or default_tokenizer()
    spark, scratch = df.sparkSession, Scratch(df.sparkSession)
    docs = only(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    size = docs.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    some = docs if size <= sample else docs.where(share_of("doc_id", "text") < sample / size)
    splitter = Splitter(path)  # made here, so that tasks need no tokenizer for it
    counts = some.select("text").mapInArrow(_counter(splitter), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    frequent = scratch.keep(encode_words(most_frequent(scratch.keep(counts), tiers), path))
    known = spark.sparkContext.broadcast(_by_number(frequent))
    # names a row's id and text, so that repeated rows have one name
    row = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    keyed = docs.withColumns({"key": F.xxhash64(row, "text"), "key_2": F.xxhash64("text", row)})

    missed = keyed.select("key", "key_2", "text").mapInArrow(_misses(known, splitter), "key long, key_2 long, place int, word string")
    found = encode_words(missed.repartition("word").sortWithinPartitions("word"), path).drop("word").withColumnRenamed("ids", "word_ids")
    # a set, as repeated rows miss the same words at the same places
    found = found.repartition("key", "key_2").groupBy("key", "key_2").agg(F.sort_array(F.collect_set(F.struct("place", "word_ids"))).alias("found"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    filled = keyed.mapInArrow(_filler(known, splitter), f"doc_id {kind}, key long, key_2 long, n long, numbers binary")
    told = filled.join(found, ["key", "key_2"], "left").select("doc_id", "n", "numbers", F.col("found.word_ids").alias("found"))
    if not decode:
        return told.mapInArrow(_joiner(known), f"doc_id {kind}, ids binary")
    join, read = _joiner(known), _decoder(path)
    return told.mapInArrow(lambda batches: read(join(batches)), f"doc_id {kind}, {_DECODED}")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """`encoded` (doc_id, ids) with n_tokens and decoded, the text that the tokenizer of `path` makes of the ids, special tokens included.

    Ids meet the table of pieces (a row for each id of the vocabulary, so its
    size is bounded) in Arrow batches; pieces are joined as the tokenizer's
    decoder does.
    """
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(path or default_tokenizer()), f"doc_id {kind}, {_DECODED}")


_DECODED = "ids binary, n_tokens long, decoded string"


def _decoder(path: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    named, plain = piece_list(_load(path)), _load(path).decoder is None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, used = pa.array(named, pa.large_string()), np.array([t is not None for t in named] + [False])
        for batch in batches:
            for part in _parts(batch, "ids"):
                ids = [np.frombuffer(x, "<u4") for x in part["ids"].to_pylist()]
                sizes = np.array([len(x) for x in ids], np.int64)
                flat = np.minimum(np.concatenate(ids), len(named))
                ends = np.concatenate([[0], np.cumsum(used[flat])])[np.concatenate([[0], np.cumsum(sizes)])]  # ids without a piece are left out
                told = pieces.take(pa.array(flat[used[flat]]))  # the join: each id with its piece
                lists = pa.LargeListArray.from_arrays(pa.array(ends), told)
                if plain:
                    text = pc.binary_join(lists, pa.scalar(" ", pa.large_string()))
                else:
                    text = pa.array(map(_load(path).decoder.decode, lists.to_pylist()), pa.large_string())
                yield pa.RecordBatch.from_arrays([part["doc_id"], part["ids"], pa.array(sizes), text.cast(pa.string())], ["doc_id", "ids", "n_tokens", "decoded"])

    return run


def piece_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """The vocabulary as a table: id, piece (null where an id is not used)."""
    return spark.createDataFrame(list(enumerate(piece_list(_load(path or default_tokenizer())))), "id int, piece string")


def piece_list(tokenizer: Tokenizer) -> list[str | None]:
    vocabulary = tokenizer.get_vocab(with_added_tokens=True)
    pieces: list[str | None] = [None] * (max(vocabulary.values()) + 1)
    for piece, at in vocabulary.items():
        pieces[at] = piece
    return pieces


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """`words` (word, and other columns) with their ids (binary); rows of one word that stand together are encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _load(path)
        last, last_ids = None, b""
        for batch in batches:
            for part in _parts(batch, "word"):
                runs = pc.run_end_encode(part["word"], run_end_type=pa.int64())
                distinct = runs.values.to_pylist()
                fresh = distinct[1:] if distinct[0] == last else distinct  # a run may go on from the part before
                ids = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(fresh, add_special_tokens=False)]
                ids = [last_ids, *ids] if len(fresh) < len(distinct) else ids
                last, last_ids = distinct[-1], ids[-1]
                of_run = np.repeat(np.arange(len(ids)), np.diff(runs.run_ends.to_numpy(), prepend=0))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.binary()).take(pa.array(of_run))], [*part.schema.names, "ids"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema)
    return words.mapInArrow(run, f"{kinds}, ids binary")


_loaded: dict[str, Tokenizer] = {}


def _load(path: str) -> Tokenizer:
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark keeps the cores busy
        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _loaded[path] = tokenizer
    return _loaded[path]


#: Fixed value: the pattern by which the 49k word vocabulary splits a text in lower case.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Texts and runs that are split by it: with these characters there is nothing to compose, and each has one lower case.
_PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
_WORDS = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+")
_RUNS = re.compile("[^\t-\r ]+")


class Splitter:
    """Cuts texts into words whose ids, one after another, are those of the text.

    A word is a run without ASCII white space; with a tokenizer that splits by
    WORD_PATTERN after lower-casing, plain runs (ASCII and Latin-1 letters) are
    split by it, so that there are fewer distinct words. Runs with an added
    token or with any other character stay whole.
    """

    def __init__(self, path: str):
        told = json.loads(_load(path).to_str())
        parts = lambda kind, name: (told[kind] or {}).get(name) or [told[kind] or {}]
        normal = [n.get("type") for n in parts("normalizer", "normalizers")] == ["NFC", "Replace", "Lowercase"]
        self.finer = normal and parts("pre_tokenizer", "pretokenizers")[0].get("pattern") == {"Regex": WORD_PATTERN}
        self.added = [t["content"].lower() for t in told["added_tokens"]]

    def is_plain(self, text: str) -> bool:
        return bool(_PLAIN.fullmatch(text)) and not any(t in text.lower() for t in self.added)

    def words(self, text: str) -> list[str]:
        if not self.finer:
            return _RUNS.findall(text)
        if self.is_plain(text):
            return _WORDS.findall(text.lower())
        out, plain = [], []
        for run in _RUNS.findall(text):
            if self.is_plain(run):
                plain.append(run)
            else:
                out += [*_WORDS.findall(" ".join(plain).lower()), run]
                plain = []
        return out + _WORDS.findall(" ".join(plain).lower())


def most_frequent(counts: DataFrame, tiers: tuple[tuple[int, int], ...]) -> DataFrame:
    """The most frequent words (word, n) of each tier: so many of at most so many bytes."""
    length = F.octet_length("word")
    tops, least = [], 0
    for most, size in tiers:
        tops.append(counts.where((length > least) & (length <= size)).orderBy(F.desc("n"), "word").limit(most))
        least = size
    return reduce(DataFrame.unionByName, tops)


def _by_number(table: DataFrame) -> pa.Table:
    """Words and their ids, the most frequent first: a word's number is its place here. The table is bounded by the tiers."""
    top = table.select("n", "word", "ids").toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    return top.select(["word", "ids"]).combine_chunks()


class _Known(dict):
    """Word to number; other words of a text get the numbers after the last known one, in the order of their first places."""

    def __init__(self, words: pa.Table):
        super().__init__((w, n) for n, w in enumerate(words["word"].to_pylist()))
        self.size, self.missed = len(self), {}

    def __missing__(self, word: str) -> int:
        return self.missed.setdefault(word, self.size + len(self.missed))


def _parts(batch: pa.RecordBatch, sized: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BATCH_BYTES bytes in a column; one larger value stands alone."""
    ends = np.cumsum(pc.binary_length(batch[sized]).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        end = max(int(np.searchsorted(ends, before + BATCH_BYTES, "right")), start + 1)
        yield batch.slice(start, end - start)
        start = end


def _counter(splitter: Splitter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words with how often they occur, added up in a task as far as memory is set aside for them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter.words
        words: Counter[str] = Counter()

        def told() -> Iterator[pa.RecordBatch]:
            whole = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.large_string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            for part in _parts(whole, "word"):
                yield pa.RecordBatch.from_arrays([part["word"].cast(pa.string()), part["n"]], ["word", "n"])
            words.clear()

        size = 0
        for batch in batches:
            for text in batch["text"]:
                words.update(split(text.as_py()))
                size += len(text.as_py())
                if size > COUNTED_CHARS:
                    size = sum(map(len, words))
                    if len(words) > COUNTED or 2 * size > COUNTED_CHARS:
                        yield from told()
                        size = 0
        yield from told()

    return run


def _misses(known: Broadcast, splitter: Splitter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each distinct word of a text that is not known, with its place among these."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, is_known = splitter.words, frozenset(known.value["word"].to_pylist()).__contains__
        for batch in batches:
            for part in _parts(batch, "text"):
                missed = [list(dict.fromkeys(filterfalse(is_known, split(text)))) for text in part["text"].to_pylist()]
                sizes = [len(m) for m in missed]
                rows = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                places = np.concatenate([np.arange(n, dtype=np.int32) for n in sizes])
                columns = [part["key"].take(rows), part["key_2"].take(rows), pa.array(places), pa.array([w for m in missed for w in m], pa.string())]
                yield pa.RecordBatch.from_arrays(columns, ["key", "key_2", "place", "word"])

    return run


def _filler(known: Broadcast, splitter: Splitter) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Texts to the numbers of their words, packed byte by byte of all numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, number_of, pack = splitter.words, _Known(known.value), pa.Codec("zstd", 1).compress
        for batch in batches:
            for part in _parts(batch, "text"):
                sizes, packed = [], []
                for text in part["text"].to_pylist():
                    words = split(text)
                    number_of.missed = {}
                    numbers = np.fromiter(map(number_of.__getitem__, words), "<u4", len(words))
                    sizes.append(len(words))
                    packed.append(pack(numbers.view(np.uint8).reshape(-1, 4).T.tobytes(), asbytes=True))
                columns = [part["doc_id"], part["key"], part["key_2"], pa.array(sizes, pa.int64()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "key_2", "n", "numbers"])

    return run


def _joiner(known: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Numbers of words to ids: those of the known words, and after them those found for the document's other words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = pa.Codec("zstd").decompress
        every = _rows(known.value["ids"])
        for batch in batches:
            for part in _parts(batch, "numbers"):
                sizes = part["n"].to_numpy()
                numbers = [np.frombuffer(unpack(x, 4 * n, asbytes=True), np.uint8).reshape(4, -1).T for x, n in zip(part["numbers"].to_pylist(), sizes, strict=True)]
                numbers = [np.ascontiguousarray(x).view("<u4").ravel().astype(np.int64) for x in numbers]
                found = part["found"].fill_null([]) if part["found"].null_count else part["found"]
                shift = 0
                for mine, n in zip(numbers, pc.list_value_length(found).to_numpy(zero_copy_only=False), strict=True):
                    mine[mine >= len(every)] += shift  # after the words of the documents before
                    shift += int(n)
                table = pa.concat_arrays([every, _rows(found.flatten())])
                told = table.take(pa.array(np.concatenate(numbers)))  # the join: each word with its ids
                counts = pc.list_value_length(told).to_numpy(zero_copy_only=False)
                ends = np.concatenate([[0], np.cumsum(counts)])[np.concatenate([[0], np.cumsum(sizes)])]
                flat = told.flatten().to_numpy(zero_copy_only=False)
                ids = [flat[a:b].tobytes() for a, b in zip(ends, ends[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return run


def _rows(ids: pa.Array | pa.ChunkedArray) -> pa.LargeListArray:
    """Ids as bytes to lists of numbers."""
    values = [np.frombuffer(x, "<u4") for x in ids.to_pylist()]
    ends = np.cumsum([0, *map(len, values)])
    return pa.LargeListArray.from_arrays(pa.array(ends, pa.int64()), pa.array(np.concatenate([np.zeros(0, "<u4"), *values])))
