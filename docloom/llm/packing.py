"""Filling fixed-capacity containers with texts.

Method: each text is a hashed token vector, projected at random to SKETCH dimensions and
from these to the few along which the corpus varies most (eigenvectors of the sketches'
covariance over all texts); the points' Hilbert keys order the texts along a
space-filling curve, so neighbours are alike.  The
curve is range-sorted into partitions (ties by id, so copies spread), and each partition
packs neighbouring texts: short windows along the curve, largest first, into the open
container that they fill best.  A container stays open for NEAR windows, so its texts are
neighbours; then only what fills it to the last FILL_STEP of its capacity may still
come.  The report gives the likeness of container mates beside the fill.

Results by case: a null text is no item; an empty text is an item of size 0; a text
larger than the container gives full pieces, each a container of its own, and a last
piece that is packed like a text; a null or non-positive capacity takes nothing;
repeated rows are separate items; empty tables give empty results.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.llm.tokens import VOCABULARY, encoding
from docloom.session import written

BUCKETS = 1024
DIMENSIONS = 4
BITS = 8
#: Texts of a window, and for how many windows a container takes any text that fits best.
WINDOW, NEAR = 256, 4
#: An older container takes only a text that leaves at most this part of its capacity free.
FILL_STEP = 1 / 64
#: Dimensions of the random projection; likeness is measured with it too.
SKETCH = 32
ROWS_PER_PARTITION = 250_000


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (rows), each coordinate of `bits` bits."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo the curve's rotations, from the highest bit down
        low = q - 1
        for i in range(n):
            flip = (x[i] & q) != 0
            swap = (x[0] ^ x[i]) & low
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = np.where(flip, x[i], x[i] ^ swap)
        q >>= 1
    for i in range(1, n):  # Gray code
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry = np.where((x[n - 1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _directions() -> np.ndarray:
    return np.random.default_rng(20_260_101).choice([-1.0, 1.0], size=(BUCKETS, SKETCH))


def _measure(path):
    def run(batches):
        enc, directions = encoding(path), _directions()
        for pdf in batches:
            sizes, sums = [], np.zeros((len(pdf), SKETCH))
            for i, text in enumerate(pdf["text"]):
                ids = np.asarray(enc.encode_ordinary(text), dtype=np.int64)
                sizes.append(len(ids))
                if len(ids):  # root counts damp frequent tokens
                    counts = np.sqrt(np.bincount((ids * 2_654_435_761 >> 7) % BUCKETS, minlength=BUCKETS))
                    sums[i] = counts @ directions / np.sqrt(counts @ counts)
            unit = sums / np.maximum(1e-12, np.linalg.norm(sums, axis=1, keepdims=True))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_tokens": sizes, "sketch": list(unit.astype(np.float32))})

    return run


class Packer:
    """Open containers of one kind, by free room: near ones of the last windows, and far ones."""

    def __init__(self, kind: str, capacity: int, prefix: str):
        self.kind, self.capacity, self.prefix, self.made, self.now = kind, capacity, prefix, 0, 0
        self.near: list[tuple[int, int]] = []  # (free room, container)
        self.far: list[tuple[int, int]] = []
        self.opened: dict[int, int] = {}  # window in which a near container was opened

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def put(self, size: int) -> int:
        at, far = bisect_left(self.near, (size, -1)), bisect_left(self.far, (size, -1))
        if far < len(self.far) and self.far[far][0] - size <= self.capacity * FILL_STEP and (at == len(self.near) or self.near[at][0] - size > self.capacity * FILL_STEP):
            free, box = self.far.pop(far)
            if free > size:
                insort(self.far, (free - size, box))
            return box
        if at < len(self.near):
            free, box = self.near.pop(at)
        else:
            free, box = self.capacity, self.new()
            self.opened[box] = self.now
        if free > size:
            insort(self.near, (free - size, box))
        return box

    def age(self) -> None:
        """The next window begins: containers of windows long past become far ones."""
        self.now += 1
        old = [x for x in self.near if self.opened[x[1]] <= self.now - NEAR]
        if old:
            self.near = [x for x in self.near if self.opened[x[1]] > self.now - NEAR]
            for x in old:
                insort(self.far, x)
        self.opened = {box: self.opened[box] for _, box in self.near}

    def window(self, doc_ids, sizes):
        """Rows (doc_id, piece, token_start, n_tokens, container) of a window's texts."""
        rows, items = [], []
        for doc, size in zip(doc_ids, sizes):
            whole, rest = divmod(size, self.capacity) if size > self.capacity else (0, size)
            rows.extend((doc, p, p * self.capacity, self.capacity, self.new()) for p in range(whole))
            if rest or not whole:
                items.append((rest, doc, whole))
        items.sort(key=lambda x: (-x[0], x[1]))
        rows.extend((doc, p, p * self.capacity, size, self.put(size)) for size, doc, p in items)
        self.age()
        return rows


def _pack(kinds):
    def run(batches):
        part = TaskContext.get().partitionId()
        packers = [Packer(kind, capacity, f"{kind}-{part:06d}") for kind, capacity in kinds]
        for pdf in batches:
            for at in range(0, len(pdf), WINDOW):
                ids, sizes = pdf["doc_id"].iloc[at : at + WINDOW].tolist(), pdf["n_tokens"].iloc[at : at + WINDOW].tolist()
                for p in packers:
                    out = pd.DataFrame(p.window(ids, sizes), columns=["doc_id", "piece", "token_start", "n_tokens", "box"])
                    out["container_id"] = p.prefix + "-" + out.pop("box").map("{:08d}".format)
                    yield out.assign(container_kind=p.kind)

    return run


def measured(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, sketch) of every text."""
    return written(documents.where("text is not null").select("doc_id", "text").mapInPandas(_measure(path), "doc_id long, n_tokens long, sketch array<float>"), "sketches")


def _moments(batches):
    """Sums of a task's sketches and of their products, with their number."""
    total = np.zeros((SKETCH + 1, SKETCH + 1))
    for pdf in batches:
        x = np.column_stack([np.stack(pdf["sketch"].to_numpy()).astype(np.float64), np.ones(len(pdf))]) if len(pdf) else np.zeros((0, SKETCH + 1))
        total += x.T @ x
    yield pd.DataFrame({"at": np.arange(total.size), "value": total.ravel()})


def along_curve(sized: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, curve): Hilbert keys of the sketches' main components, each scaled by its spread."""
    moments = np.zeros((SKETCH + 1) ** 2)
    for r in sized.mapInPandas(_moments, "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).collect():  # (SKETCH + 1)^2 numbers
        moments[r["at"]] = r["value"]
    moments = moments.reshape(SKETCH + 1, SKETCH + 1)
    n = max(1.0, moments[-1, -1])
    mean = moments[-1, :-1] / n
    spread, axes = np.linalg.eigh(moments[:-1, :-1] / n - np.outer(mean, mean))
    axes, spread = axes[:, ::-1][:, :DIMENSIONS], np.sqrt(np.maximum(spread[::-1][:DIMENSIONS], 1e-12))
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(DIMENSIONS)])

    def keys(batches):
        for pdf in batches:
            points = (np.stack(pdf["sketch"].to_numpy()) - mean) @ axes / spread if len(pdf) else np.zeros((0, DIMENSIONS))
            grid = np.clip((np.tanh(points * 0.8) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1)  # about even over a normal spread
            yield pdf[["doc_id", "n_tokens"]].assign(curve=hilbert_keys(grid, BITS))

    return sized.mapInPandas(keys, "doc_id long, n_tokens long, curve long")


def pack(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(container_kind, container_id, doc_id, piece, token_start, n_tokens) for every text and every kind of container."""
    return _packed(measured(documents, path), containers)


def _packed(sized: DataFrame, containers: DataFrame) -> DataFrame:
    spark = sized.sparkSession
    kinds = [(r["container_kind"], r["capacity_tokens"]) for r in containers.where("capacity_tokens > 0").distinct().orderBy("container_kind").collect()]
    parts = -(-sized.count() // ROWS_PER_PARTITION) or 1
    parts = max(parts, min(int(spark.conf.get("spark.sql.shuffle.partitions")), parts * 8))
    ordered = along_curve(sized).repartitionByRange(parts, "curve", "doc_id").sortWithinPartitions("curve", "doc_id")
    return ordered.mapInPandas(_pack(kinds), "doc_id long, piece int, token_start long, n_tokens long, container_id string, container_kind string").select(
        "container_kind", "container_id", "doc_id", "piece", "token_start", "n_tokens")


def fill_report(documents: DataFrame, containers: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Per kind: containers used, tokens held, the share of room that is filled, and the likeness of container mates.

    Likeness is the mean cosine of sketches over pairs of texts in a container, all_likeness
    that over all pairs of texts; pairs are summed by the norm of vector sums, never listed.
    """
    sized = measured(documents, path)
    packed = written(_packed(sized, containers), "packed")
    sketches = sized.where("n_tokens > 0").select("doc_id", *[F.col("sketch")[i].alias(f"s{i}") for i in range(SKETCH)])
    sums = [F.sum(f"s{i}").alias(f"s{i}") for i in range(SKETCH)]
    square = sum((F.col(f"s{i}") * F.col(f"s{i}") for i in range(1, SKETCH)), F.col("s0") * F.col("s0"))
    boxes = packed.join(sketches, "doc_id", "left").groupBy("container_kind", "container_id").agg(F.sum("n_tokens").alias("n_tokens"), F.count("s0").alias("k"), *sums)
    pairs = F.col("k") * (F.col("k") - 1)
    per = boxes.groupBy("container_kind").agg(F.count("*").alias("n_containers"), F.sum("n_tokens").alias("n_tokens"), (F.sum(F.when(pairs > 0, square - F.col("k"))) / F.sum(pairs)).alias("likeness"))
    every = sketches.agg(F.count("*").alias("k"), *sums).select(F.when(pairs > 0, (square - F.col("k")) / pairs).alias("all_likeness"))
    return containers.select("container_kind", "capacity_tokens").join(per, "container_kind", "left").crossJoin(F.broadcast(every)).select(
        "container_kind", "capacity_tokens", F.coalesce("n_containers", F.lit(0)).alias("n_containers"), F.coalesce("n_tokens", F.lit(0)).alias("n_tokens"),
        (F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))).alias("filled"), "likeness", "all_likeness")
