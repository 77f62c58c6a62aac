"""Audio features of a media column: polyphase resampling, log-mel filterbanks and hysteresis energy segmentation.

A clip is a payload of unsigned 8-bit PCM at ``SOURCE_RATE``. It is brought to ``RATE`` (a ratio of UP / DOWN) by a windowed-sinc low-pass in
polyphase form: every block of DOWN inputs, with the neighbours that the filter reaches, makes a block of UP outputs by one matrix product. Frames of
``FRAME`` samples every ``HOP``, so that they overlap, go through a Hann window, a power spectrum and ``MELS`` triangular filters on the mel scale;
their natural logarithms are kept. A frame is active from an energy of the upper threshold on, and stays so until it falls below the lower one;
both lie between the clip's quiet (10th percentile) and loud (95th) frames. Active runs of ``LEAST`` frames or more are segments.

One row a tensor: doc_id, chunk, start_s and end_s of its frames, n_frames that are filled (the rest are 0), logmel and the segments that begin in it. logmel is an
Arrow tensor of ``CHUNK`` x ``MELS`` float32 with named dimensions, as the message that pyarrow.ipc.read_tensor reads; all have one shape and so one header. to_tensors() turns the
column into Arrow's fixed-shape tensor type, and write_tensors() has the executors write Parquet files with it.

The tables hold no audio, so the query takes the UTF-8 bytes of documents.text as payloads: whole texts, whole table.

Results for odd input: a null or empty payload is no clip and has no row; a payload of less than a frame is one frame, filled up with silence; a clip of even
energy is one segment, or none below the floor of ``SILENCE_DB``; a null doc_id stays null; repeated rows are analysed each; an empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .bytesops import text_slices
from .tables import documents

SOURCE_RATE, RATE = 22_050, 16_000
UP, DOWN = 320, 441
#: Inputs that the filter reaches on either side.
REACH = 16
FRAME, HOP, FFT, MELS = 400, 160, 512, 40
CHUNK = 32
LOG_FLOOR, SILENCE_DB = 1e-10, -60.0
#: Thresholds between the quiet and the loud level of a clip, and the range below which a clip is even.
UPPER, LOWER, EVEN_DB, LEAST = 0.6, 0.4, 3.0, 3


def low_pass(t: np.ndarray) -> np.ndarray:
    """The filter at t inputs from its centre: a sinc of the lower Nyquist rate under a Hann window."""
    cut = min(1.0, RATE / SOURCE_RATE)
    return cut * np.sinc(cut * t) * np.where(np.abs(t) < REACH, 0.5 + 0.5 * np.cos(np.pi * t / REACH), 0.0)


def polyphase_matrix() -> np.ndarray:
    """(DOWN + 2 REACH, UP): weights of a block's inputs, with REACH neighbours on either side, for each of its outputs."""
    into = np.arange(DOWN + 2 * REACH)[:, None] - REACH
    return low_pass(into - np.arange(UP)[None, :] * DOWN / UP).astype(np.float32)


def mel_filters() -> np.ndarray:
    """(FFT / 2 + 1, MELS) triangles, evenly spaced on the mel scale from 0 to the Nyquist rate."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(0, mel(RATE / 2), MELS + 2) / 2595) - 1)
    f = np.arange(FFT // 2 + 1) * RATE / FFT
    rise = (f[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


_MATRIX, _MEL, _HANN = polyphase_matrix(), mel_filters(), np.hanning(FRAME + 1)[:-1].astype(np.float32)


def resample(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Samples of all clips, silent between them, the place of each clip's first one and the number of its samples. No clip is empty."""
    size = np.diff(offsets)
    blocks = -(-size // DOWN)
    gap = 2  # silent blocks after a clip: more than a frame, and more than the filter reaches
    at = np.concatenate([[0], np.cumsum(blocks + gap)])
    mean = np.add.reduceat(data, offsets[:-1], dtype=np.float64) / size
    x = np.zeros(int(at[-1]) * DOWN + 2 * REACH, np.float32)
    clip = np.repeat(np.arange(len(size)), size)
    x[np.arange(len(data)) - offsets[:-1][clip] + at[:-1][clip] * DOWN + REACH] = (data - mean[clip]) / 128
    windows = np.lib.stride_tricks.sliding_window_view(x, DOWN + 2 * REACH)[::DOWN]
    y = (np.ascontiguousarray(windows) @ _MATRIX).ravel()
    count = -(-size * UP // DOWN)
    first = at[:-1] * UP
    # What rings after a clip's end isn't part of it.
    edge = np.zeros(len(y) + 1, np.int8)
    edge[first] += 1
    edge[first + count] -= 1
    y *= np.cumsum(edge[:-1], dtype=np.int8)
    return y, first, count


def frames_of(y: np.ndarray, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frames (F, FRAME), and the first of each clip (with a last entry); the last frame of a clip is filled up with silence."""
    n = np.maximum(1, -(-(count - FRAME) // HOP) + 1)
    rows = np.concatenate([[0], np.cumsum(n)])
    clip = np.repeat(np.arange(len(n)), n)
    begin = first[clip] + HOP * (np.arange(rows[-1]) - rows[:-1][clip])
    return np.lib.stride_tricks.sliding_window_view(y, FRAME)[begin], rows


def log_mel(frames: np.ndarray) -> np.ndarray:
    power = np.square(np.abs(np.fft.rfft(frames * _HANN, FFT, axis=1))).astype(np.float32)
    return np.log(np.maximum(power @ _MEL, LOG_FLOOR))


def active_frames(energy: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Which frames are active, by hysteresis within each clip. energy: dB, float32."""
    n = np.diff(rows)
    clip = np.repeat(np.arange(len(n)), n)
    ranked = energy[np.lexsort((energy, clip))]
    quiet, loud = ranked[rows[:-1] + (n - 1) // 10], ranked[rows[:-1] + (n - 1) * 95 // 100]
    even = loud - quiet < EVEN_DB
    upper, lower = quiet + np.float32(UPPER) * (loud - quiet), quiet + np.float32(LOWER) * (loud - quiet)
    upper = np.maximum(np.where(even, SILENCE_DB, upper), SILENCE_DB).astype(np.float32)
    lower = np.where(even, SILENCE_DB, lower).astype(np.float32)
    sets, falls = energy >= upper[clip], energy < lower[clip]
    event = np.where(sets | falls, np.arange(len(energy)), -1)
    latest = np.maximum.accumulate(event)
    return (latest >= rows[:-1][clip]) & sets[np.maximum(latest, 0)]


def segments_of(active: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last frame of the active runs of LEAST frames or more (a clip that is shorter counts whole)."""
    edge = np.zeros(len(active) + 1, bool)
    edge[rows] = True
    opens = active.copy()
    opens[1:] &= ~active[:-1] | edge[1:-1]
    closes = active.copy()
    closes[:-1] &= ~active[1:] | edge[1:-1]
    begin, end = np.flatnonzero(opens), np.flatnonzero(closes)
    whole = np.diff(rows)[np.searchsorted(rows, begin, "right") - 1]
    keep = end - begin + 1 >= np.minimum(LEAST, whole)
    return begin[keep], end[keep]


_SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
    T.StructField("n_frames", T.IntegerType()), T.StructField("logmel", T.BinaryType(), metadata={"arrow_tensor": "float32", "shape": [CHUNK, MELS]}),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
])


def _header() -> np.ndarray:
    """What stands before the values in the message of a tensor of this shape."""
    zero, out = np.zeros((CHUNK, MELS), np.float32), pa.BufferOutputStream()
    pa.ipc.write_tensor(pa.Tensor.from_numpy(zero, ["frame", "mel"]), out)
    message = out.getvalue().to_pybytes()
    return np.frombuffer(message[: len(message) - zero.nbytes], np.uint8)


_HEADER = _header()


def messages(tensors: np.ndarray) -> pa.Array:
    """(n, CHUNK, MELS) as n tensor messages."""
    n = len(tensors)
    data = np.empty((n, len(_HEADER) + 4 * CHUNK * MELS), np.uint8)
    data[:, : len(_HEADER)] = _HEADER
    data[:, len(_HEADER) :] = tensors.reshape(n, -1).view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * data.shape[1]).astype(np.int32)), pa.py_buffer(data)])


def values_of(column: pa.Array) -> np.ndarray:
    """The tensors (n, CHUNK, MELS) of messages."""
    first = np.frombuffer(column.buffers()[1], np.int32)[column.offset] if len(column) else 0
    width = len(_HEADER) + 4 * CHUNK * MELS
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[first : first + width * len(column)].reshape(len(column), width)
    return np.ascontiguousarray(data[:, len(_HEADER) :]).view(np.float32).reshape(-1, CHUNK, MELS)


def _clips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, data, offsets in text_slices(batch["payload"]):
            has = np.flatnonzero(np.diff(offsets) > 0)
            if not len(has):
                continue
            y, first, count = resample(data, np.append(offsets[:-1][has], offsets[-1]))
            frames, rows = frames_of(y, first, count)
            mel = log_mel(frames)
            energy = (10 * np.log10(np.maximum(np.square(frames).mean(1), LOG_FLOOR))).astype(np.float32)
            begin, end = segments_of(active_frames(energy, rows), rows)
            # Chunks: CHUNK frames each, the last of a clip filled up.
            n = np.diff(rows)
            chunks = -(-n // CHUNK)
            clip = np.repeat(np.arange(len(n)), chunks)
            number = np.arange(len(clip)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
            filled = np.minimum(CHUNK, n[clip] - number * CHUNK)
            tensor = np.zeros((len(clip), CHUNK, MELS), np.float32)
            owner = np.repeat(np.arange(len(clip)), filled)
            tensor[owner, np.arange(len(mel)) - np.repeat(np.cumsum(filled) - filled, filled)] = mel
            seconds = count / RATE
            of_segment = np.searchsorted(rows, begin, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array((begin - rows[of_segment]) * HOP / RATE), pa.array(np.minimum(((end - rows[of_segment]) * HOP + FRAME) / RATE, seconds[of_segment]))], ["start_s", "end_s"])
            chunk_begin = rows[:-1][clip] + number * CHUNK
            yield pa.RecordBatch.from_arrays([
                batch["doc_id"].slice(a, b - a).take(pa.array(has[clip])).cast(pa.int64()), pa.array(number, pa.int32()), pa.array(number * CHUNK * HOP / RATE),
                pa.array(np.minimum(((number * CHUNK + filled - 1) * HOP + FRAME) / RATE, seconds[clip])), pa.array(filled, pa.int32()),
                messages(tensor),
                pa.ListArray.from_arrays(pa.array(np.append(np.searchsorted(begin, chunk_begin), len(begin)), pa.int32()), spans),
            ], _SCHEMA.names)


def audio_features(clips: DataFrame, payload: str = "payload") -> DataFrame:
    """clips: doc_id and a binary (or string) payload column."""
    return clips.select("doc_id", clips[payload].alias("payload")).mapInArrow(_clips, _SCHEMA)


def to_tensors(batch: pa.RecordBatch | pa.Table) -> pa.RecordBatch | pa.Table:
    """The same rows with logmel as fixed-shape tensors."""
    kind = pa.fixed_shape_tensor(pa.float32(), (CHUNK, MELS), dim_names=("frame", "mel"))
    at = batch.schema.get_field_index("logmel")
    column = batch.column(at)
    parts = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    made = [pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(values_of(p).ravel()), CHUNK * MELS)) for p in parts]
    return batch.set_column(at, pa.field("logmel", kind), pa.chunked_array(made, kind) if isinstance(column, pa.ChunkedArray) else made[0])


def write_tensors(features: DataFrame, uri: str) -> DataFrame:
    """Writes Parquet files with tensor columns into the folder, which all executors share: one a partition, moved into place when it is whole. Gives file and rows of each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = pa.fs.FileSystem.from_uri(uri)
        fs.create_dir(folder, recursive=True)
        name, part, rows, writer = f"part-{task.partitionId():05d}.parquet", f"{folder}/.part-{task.partitionId():05d}-{task.taskAttemptId()}", 0, None
        for batch in batches:
            made = to_tensors(batch)
            writer = writer or pq.ParquetWriter(part, made.schema, filesystem=fs)
            writer.write_batch(made)
            rows += made.num_rows
        if writer:
            writer.close()
            fs.move(part, f"{folder}/{name}")
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([rows], pa.int64())], ["file", "n_rows"])

    return features.mapInArrow(write, "file string, n_rows long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_features(documents(spark, sf_dir), "text")
