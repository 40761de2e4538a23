"""Mixture-controlled packing of token streams into fixed windows.

Deficit round-robin: each source is a queue, and a round gives every queue a quantum,
its share of a window. A queue sends its next packet once its saved quanta cover it;
what is left over is its deficit for the next round. A queue's deficit after r rounds is
r times its quantum less what it has sent, so a packet leaves in round
ceil(tokens up to and with it / quantum) - which a running total per source gives for
all packets at once, with deficits carried over every window and partition. The sent
packets, one after the other, are cut into windows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavspark.llm import tokens
from eavspark.llm.shared import lean, running_total, stage

WINDOW = 2048
#: Tokens of a packet at most, and at least: the grain to which a window keeps the proportions.
PACKET, FEW = 512, 64
END = 1


def tokenized(documents: DataFrame, vocabulary: str, end: int) -> DataFrame:
    """doc_id, source, n_ids and ids (16-bit little-endian, deflated by Parquet) with the end id; null text is empty."""
    tail = np.array([end], "<u2").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoders(vocabulary)
        for batch in batches:
            for part in tokens.parts(batch["text"]):
                rows = batch.slice(*part)
                ids = [x + tail for x in encode([t or "" for t in rows["text"].to_pylist()])]
                yield pa.RecordBatch.from_arrays(
                    [rows["doc_id"], rows["source"], pa.array([len(x) // 2 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    ["doc_id", "source", "n_ids", "ids"],
                )

    ids = documents.select("doc_id", "source", "text").mapInArrow(lean(run), "doc_id long, source string, n_ids long, ids binary")
    return stage(ids.withColumn("row", F.monotonically_increasing_id()), "tokens")


def plan(rows: DataFrame, window: int = WINDOW, packet: int = PACKET, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Where each piece goes: row, start, length, sequence_id, offset, from (row, source, n_ids).

    A queue's quantum is its weight's part of a window; without ``weights``, by source, its tokens are its weight, so that all
    queues end together. A source that ``weights`` doesn't name has weight 1. With weights a queue may end before
    others, which then share the windows by theirs. A packet is a quantum, but FEW tokens at least and ``packet`` at most, so that
    a small source isn't bunched. A null source is a queue of its own. The queue's order is that of a hash of the row
    number, so that the documents of one input file don't come in a run.
    """
    rows = rows.select("row", "n_ids", F.coalesce(F.concat(F.lit("="), "source"), F.lit("-")).alias("queue"))
    totals = rows.groupBy("queue").agg(F.sum("n_ids").cast("double").alias("weight"))
    if weights is not None:
        named = F.create_map(*[F.lit(x) for k, w in weights.items() for x in ("-" if k is None else f"={k}", float(w))]) if weights else F.create_map().cast("map<string,double>")
        totals = totals.withColumn("weight", F.coalesce(F.element_at(named, F.col("queue")), F.lit(1.0)))
    # one number, the sum, comes to the driver
    whole = totals.agg(F.sum("weight")).first()[0] or 1.0
    quantum = F.lit(float(window)) * F.col("weight") / F.lit(whole)
    totals = totals.select("queue", quantum.alias("quantum"), F.least(F.lit(packet), F.greatest(F.lit(FEW), F.ceil(quantum))).cast("int").alias("packet"))
    packets = rows.join(totals, "queue").withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_ids") / F.col("packet")).cast("int") - 1)))
    packets = packets.select(
        "row", "queue", "quantum", (F.col("k") * F.col("packet")).cast("long").alias("start"),
        F.least(F.col("packet"), F.col("n_ids") - F.col("k") * F.col("packet")).cast("long").alias("length"),
        F.xxhash64("row").alias("place"),
    )
    queued = running_total(packets, ["place", "row", "start"], "length", ["queue"], "sent")
    queued = queued.withColumn("round", F.ceil((F.col("sent") + F.col("length")) / F.col("quantum")).cast("long"))
    stream = running_total(queued.select("row", "start", "length", "queue", "round", "place"), ["round", "queue", "place", "row", "start"], "length", [], "at")
    first, last = F.floor(F.col("at") / window), F.floor((F.col("at") + F.col("length") - 1) / window)
    stream = stream.withColumn("sequence_id", F.explode(F.sequence(first, last)))
    low = F.greatest(F.col("at"), F.col("sequence_id") * window)
    high = F.least(F.col("at") + F.col("length"), (F.col("sequence_id") + 1) * window)
    return stream.select(
        "row", (F.col("start") + low - F.col("at")).alias("start"), (high - low).alias("length"),
        "sequence_id", (low - F.col("sequence_id") * window).alias("offset"),
    )


def pack(documents: DataFrame, vocabulary: str | None = None, end: int = END, window: int = WINDOW, packet: int = PACKET, weights: dict[str | None, float] | None = None) -> DataFrame:
    """Pack all documents into sequences of ``window`` tokens, each filled to the proportions of the sources, or to ``weights`` by source.

    Returns one row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source and ids (array of int). Every id, with the end id that closes each
    document, lies in one piece; only the last sequence is not full. Null and empty
    texts are the end id alone; a null source is a source; repeated rows and ids are
    packed one by one; a text of any length is cut at windows and packets. An empty
    table gives no pieces. Other columns are ignored.
    """
    rows = tokenized(documents, vocabulary or tokens.path("word_bpe_49k.json"), end)
    pieces = plan(rows, window, packet, weights)
    of = pieces.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "length", "sequence_id", "offset"))).alias("pieces"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 256):
                rows = batch.slice(part, 256)
                # pieces in the order of a document's ids: so the ids follow one another as they are
                start, length, sequence, offset = rows["pieces"].flatten().flatten()
                take = rows.take(pa.array(np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["pieces"]).to_numpy())))
                ids = np.frombuffer(b"".join(rows["ids"].to_pylist()), "<u2").astype("<u4")
                ends = np.append(0, np.cumsum(length.to_numpy()))
                raw = memoryview(ids.tobytes())
                crcs = [zlib.crc32(raw[a:b]) for a, b in zip((4 * ends[:-1]).tolist(), (4 * ends[1:]).tolist())]
                columns = {
                    "doc_id": take["doc_id"], "start": start, "length": length, "ids_crc32": pa.array(crcs, pa.int64()), "doc_tokens": take["n_ids"], "sequence_id": sequence,
                    "offset": offset, "source": take["source"], "ids": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids.view(np.int32))),
                }
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string, ids array<int>"
    return rows.join(of, "row").select("doc_id", "source", "n_ids", "ids", "pieces").mapInArrow(lean(cut), schema)
