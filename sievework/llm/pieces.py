"""SentencePiece encoding and decoding.

Models that choose the segmentation of highest total score (unigram) are encoded by a relational lattice, in
DataFrame functions only: substrings of bounded length are exploded from distinct words, joined to the piece table
by equality, grouped by word, and a higher-order fold keeps the best score and the back pointer of each position.

Merge models (BPE) are not of that kind: their scores are ranks of merges, and the best total of ranks is another
segmentation than the merges give. Over the same lattice a fold of merges gives the right ids (merge_documents): it
joins the adjacent symbols of best score, the leftmost of ties, until no edge joins two. Sending the ids of distinct
words back to whole texts shuffles several times the input, so encode_documents, which the query uses, encodes by the
library's merges where the texts are, word by word with a cache. No piece of such a model has a word boundary after
another character, so words between single spaces can be encoded alone; texts with other runs of spaces are encoded
whole.

Defined results: null and empty texts have no ids and decode to the empty text; a null id is kept; repeated rows
are encoded each; an empty table gives no rows; in the lattice, a character that no piece covers is the unknown
piece or, in a merge model with bytes as pieces, its bytes; a piece that a table repeats counts with its best score
and then its least id; a word's work grows with its length times the number of its edges; an empty table of pieces
leaves unknown pieces. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_SHARE, materialize, meet, table

BOUNDARY = "▁"
CACHE_WORDS = 400_000
UNKNOWN_PENALTY = 10.0


def lattice(words: DataFrame, pieces: DataFrame, max_length: int) -> DataFrame:
    """(word, at, stop, first, id, score): the edges of a distinct column word, those of one character without a piece too.

    The piece table has at most as many rows as its model has pieces, so it is broadcast and words stay where they are.
    """
    best = F.max_by(F.struct("id", "score"), F.struct(F.col("score"), -F.col("id"))).alias("best")
    table = F.broadcast(pieces.groupBy("piece").agg(best).select("piece", "best.*"))
    spans = words.where(F.length("word") > 0).select("word", F.posexplode(F.split("word", "")).alias("at", "first"))
    lengths = F.sequence(F.lit(1), F.least(F.lit(max_length), F.length("word") - F.col("at")))
    spans = spans.select("word", "at", "first", F.explode(lengths).alias("n"))
    spans = spans.select("word", "at", (F.col("at") + F.col("n")).alias("stop"), "first", F.expr("substring(word, at + 1, n)").alias("piece"))
    return spans.join(table, "piece", "left").where(F.col("id").isNotNull() | (F.col("stop") == F.col("at") + 1)).drop("piece")


def encode_lattice(words: DataFrame, pieces: DataFrame, max_length: int, unknown_id: int = 0) -> DataFrame:
    """(word, ids) of a distinct column word under a unigram table (piece, id, score)."""
    worst = pieces.agg((F.coalesce(F.min("score"), F.lit(0.0)) - UNKNOWN_PENALTY).alias("worst"))
    edges = lattice(words, pieces, max_length).crossJoin(F.broadcast(worst))
    edge = F.struct("stop", "at", F.coalesce("score", "worst").alias("score"), F.coalesce("id", F.lit(unknown_id)).alias("id"))
    lattice_ = edges.groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    none = F.struct(F.lit(float("-inf")).alias("score"), F.lit(-1).alias("at"), F.lit(-1).alias("id"))
    start = F.struct(F.lit(0.0).alias("score"), F.lit(-1).alias("at"), F.lit(-1).alias("id"))

    def step(state, e):
        total = F.element_at(state, e.at + 1).score + e.score
        better = F.struct(total.alias("score"), e["at"].alias("at"), e.id.cast("int").alias("id"))
        return F.transform(state, lambda s, i: F.when((i == e.stop) & (total > s.score), better).otherwise(s))

    empty = F.concat(F.array(start), F.array_repeat(none, F.length("word")))
    best = lattice_.select("word", F.aggregate("edges", empty, step).alias("best"))
    back = F.struct(F.length("word").alias("at"), F.array().cast("array<int>").alias("ids"))

    def follow(state, _):
        here = F.element_at(F.col("best"), state.at + 1)
        moved = F.struct(here["at"].alias("at"), F.concat(F.array(here.id), state.ids).alias("ids"))
        return F.when(state.at > 0, moved).otherwise(state)

    return best.select("word", F.aggregate(F.sequence(F.lit(1), F.length("word")), back, follow).ids.alias("ids"))


def unigram_documents(docs: DataFrame, pieces: DataFrame, max_length: int, unknown_id: int = 0) -> DataFrame:
    """(doc_id, ids) of whole texts under a unigram table: distinct words are encoded once and joined back."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("row_", F.monotonically_increasing_id())
    parts = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split("text", " ", -1))
    words = rows.select("doc_id", "row_", F.posexplode_outer(parts).alias("at", "w")).withColumn("word", F.concat(F.lit(BOUNDARY), "w"))
    coded = encode_lattice(words.select("word").where("word is not null").distinct(), pieces, max_length, unknown_id)
    joined = words.join(coded, "word", "left").groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return joined.select("doc_id", F.flatten(F.filter(F.transform("parts", lambda p: p.ids), lambda x: x.isNotNull())).alias("ids"))


def encode_merges(words: DataFrame, pieces: DataFrame, max_length: int, unknown_id: int = 0, first_byte: int | None = None) -> DataFrame:
    """(word, ids) of a distinct column word under a table (piece, id, score) of merges.

    first_byte is the id of byte 0 where the model has the 256 bytes as pieces, one after the other.
    """
    raw = F.encode("first", "UTF-8")
    codes = F.transform(F.sequence(F.lit(1), F.octet_length(raw)), lambda k: F.conv(F.hex(F.substring(raw, k, F.lit(1))), 16, 10).cast("int") + (first_byte or 0))
    spare = F.array(F.lit(unknown_id)) if first_byte is None else codes
    ids = F.when(F.col("id").isNotNull(), F.array(F.col("id").cast("int"))).otherwise(spare)
    edge = F.struct((-F.col("score")).alias("cost"), "at", "stop", ids.alias("ids"))
    edges = lattice(words, pieces, max_length).groupBy("word").agg(F.array_sort(F.collect_list(edge)).alias("edges"))
    single = lambda e: e.stop == e["at"] + 1
    # Edges of one character never join symbols; those that do are in the order of merging.
    edges = edges.select("word", F.filter("edges", single).alias("ones"), F.filter("edges", lambda e: ~single(e)).alias("joins"))
    # A position holds where the symbol that starts there ends, and 0 where none starts.
    alone = F.sequence(F.lit(1), F.length("word"))

    def step(ends, _):
        found = F.get(F.filter("joins", lambda e: F.get(ends, F.nullif(F.get(ends, e["at"]), F.lit(0))) == e.stop), F.lit(0))

        def move(joined):
            moved = F.transform(ends, lambda end, i: F.when(i == joined["at"], joined.stop).when((i > joined["at"]) & (i < joined.stop), 0).otherwise(end))
            return F.when(joined.isNull(), ends).otherwise(moved)

        # The list of one binds the edge, which would be searched again at each position otherwise.
        return F.get(F.transform(F.array(found), move), F.lit(0))

    rounds = F.when(F.size("joins") > 0, F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    merged = edges.withColumn("ends", F.aggregate(rounds, alone, step))
    spelled = lambda from_, i, end: F.get(F.filter(from_, lambda e: (e["at"] == i) & (e.stop == end)), F.lit(0)).ids
    symbol = lambda end, i: F.when(end == i + 1, spelled("ones", i, end)).when(end > 0, spelled("joins", i, end)).otherwise(F.array().cast("array<int>"))
    return merged.select("word", F.flatten(F.transform("ends", symbol)).alias("ids"))


def merge_pieces(spark: SparkSession, model_file: str) -> tuple[DataFrame, int, int, int | None]:
    """The table of pieces of a merge model, the length of the longest, the unknown id and the id of byte 0."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    of_bytes = [i for i in range(model.get_piece_size()) if model.is_byte(i)]
    plain = [i for i in range(model.get_piece_size()) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
    rows = [(model.id_to_piece(i), i, model.get_score(i)) for i in plain]
    return spark.createDataFrame(rows, "piece string, id int, score double"), max((len(p) for p, _, _ in rows), default=1), model.unk_id(), of_bytes[0] if of_bytes else None


def merge_documents(docs: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, ids as an array) of whole texts under a merge model, in DataFrame functions only.

    A word starts with its run of boundaries. Distinct words are encoded once; the ids of hot words reach their places
    by a broadcast of at most HOT_SHARE rows, those of others by a shuffle.
    """
    pieces, longest, unknown_id, first_byte = merge_pieces(docs.sparkSession, model_file)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("row_", F.monotonically_increasing_id())
    marked = F.concat(F.lit(BOUNDARY), F.translate("text", " ", BOUNDARY))
    parts = F.when(F.col("text") == "", F.array().cast("array<string>")).otherwise(F.split(marked, f"(?<=[^{BOUNDARY}])(?={BOUNDARY})"))
    words = rows.select("doc_id", "row_", F.posexplode_outer(parts).alias("at", "word"))
    counted = words.where("word is not null").groupBy("word").agg(F.count(F.lit(1)).alias("n_"))
    coded = encode_merges(counted.select("word"), pieces, longest, unknown_id, first_byte).join(counted, "word")
    coded = materialize(coded, "words")
    total = coded.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    found = meet(words.where("word is not null"), coded, ["word"], F.col("n_") * HOT_SHARE > total).select("doc_id", "row_", "at", "ids")
    none = words.where("word is null").select("doc_id", "row_", F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    whole = found.unionByName(none).groupBy("row_").agg(F.first("doc_id").alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", "ids"))).alias("parts"))
    return whole.select("doc_id", F.flatten(F.transform("parts", lambda p: p.ids)).alias("ids"))


class MergeEncoder:
    """Ids of whole texts under a merge model as little-endian 32-bit bytes, with a cache by word."""

    def __init__(self, model_file: str, cache_words: int = CACHE_WORDS):
        import sentencepiece

        self.model = model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        pieces = map(model.id_to_piece, range(model.get_piece_size()))
        self.by_word = not any(BOUNDARY in p[1:] and p.strip(BOUNDARY) for p in pieces)

        class Cache(dict):
            def __missing__(self, word: str) -> bytes:
                if len(self) >= cache_words:
                    self.clear()
                value = self[word] = array("I", model.encode(word)).tobytes()
                return value

        self.cache = Cache()

    def __call__(self, text: str) -> bytes:
        words = text.split(" ")
        if not self.by_word or "" in words or BOUNDARY in text:
            return array("I", self.model.encode(text)).tobytes()
        return b"".join(map(self.cache.__getitem__, words))


ENCODED = "doc_id long, ids binary"


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids as little-endian 32-bit bytes) of whole texts under a merge model."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = MergeEncoder(model_file)
        for batch in batches:
            ids = [encoder(t.as_py() or "") for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, ENCODED)


def decode_documents(encoded: DataFrame, model_file: str) -> DataFrame:
    """(doc_id, text) of encoded rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            texts = [model.decode(array("I", b).tolist()) for b in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


RESULT = "doc_id long, n_ids long, ids_crc32 long, decoded_chars long, decoded_sha256 string"


def digest(encoded: DataFrame, model_file: str) -> DataFrame:
    """Digests of ids and of the texts decoded from them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                text = model.decode(array("I", ids).tolist())
                rows.append((doc, len(ids) // 4, zlib.crc32(ids), len(text), hashlib.sha256(text.encode()).hexdigest()))
            cols = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], [f.split()[0] for f in RESULT.split(", ")])

    return encoded.mapInArrow(run, RESULT)


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op7_sentencepiece(spark, sf_dir: str) -> DataFrame:
    model = default_model()
    return digest(encode_documents(table(spark, sf_dir, "documents"), model), model)
