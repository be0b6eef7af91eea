"""Text to vector, in Arrow batches, by a function the caller supplies.

A provider takes a list of texts and returns as many vectors. The default one
hashes words into buckets; it needs no model and gives the same vector anywhere.
"""

import hashlib
from collections.abc import Callable, Iterator, Sequence
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textmill.functions.vectors import has_dimension

Provider = Callable[[Sequence[str]], Sequence[Sequence[float]]]

HASH_DIM = 64
CACHED_WORDS = 1 << 18
# Bytes of text that are taken out of an Arrow batch at a time, up to the last of them.
SLICE_BYTES = 4 << 20


class _Buckets(dict):
    """Word to bucket, remembered up to a limit."""

    def __init__(self, dim):
        super().__init__()
        self.dim = dim

    def __missing__(self, word):
        if len(self) >= CACHED_WORDS:
            self.clear()
        digest = hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()
        bucket = self[word] = int(digest[:8], 16) % self.dim
        return bucket


class HashProvider:
    """Counts of words per md5 bucket, scaled to unit length."""

    def __init__(self, dim: int = HASH_DIM):
        self.dim = dim
        self.buckets = _Buckets(dim)

    def __reduce__(self):
        return HashProvider, (self.dim,)

    def __call__(self, texts):
        # Words are told apart by Arrow; only the distinct ones of a batch are hashed.
        words = pc.ascii_split_whitespace(pa.array(texts, pa.large_string()))
        coded = words.flatten().dictionary_encode()
        buckets = np.array([self.buckets[w] if w else -1 for w in coded.dictionary.to_pylist()], np.int64)
        at = buckets[coded.indices.to_numpy()] if len(coded) else np.zeros(0, np.int64)
        row = pc.list_parent_indices(words).to_numpy()
        cells = (row * self.dim + at)[at >= 0]
        vectors = np.bincount(cells, minlength=len(texts) * self.dim).reshape(len(texts), self.dim).astype(float)
        length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
        return (vectors / np.where(length == 0, 1, length)).astype(np.float32)


def choose_provider(mode: str, local: Provider, remote: Provider) -> Provider:
    """The local model for a standalone run, the remote one in the cloud."""
    return {"standalone": local, "cloud": remote}[mode]


def _vectors(provider: Provider, texts: list, dim: int):
    """Vectors and errors of one batch. A failing batch is halved until the texts at fault
    are alone, so one of them costs a few calls. A null text gets neither."""
    filled = [i for i, text in enumerate(texts) if text is not None]
    if len(filled) < len(texts):
        vectors, errors = [None] * len(texts), [None] * len(texts)
        made = _vectors(provider, [texts[i] for i in filled], dim)
        for i, vector, error in zip(filled, *made):
            vectors[i], errors[i] = vector, error
        return vectors, errors
    if not texts:
        return [], []
    try:
        made = np.asarray(provider(texts), dtype=np.float32)
        if made.shape == (len(texts), dim):
            return list(made), [None] * len(texts)
        problem = ValueError(f"expected {dim} dimensions, got {made[0].size if made.ndim else 0}")
    except Exception as raised:
        problem = raised
    if len(texts) == 1:
        return [None], [f"{type(problem).__name__}: {problem}"]
    middle = len(texts) // 2
    left, right = _vectors(provider, texts[:middle], dim), _vectors(provider, texts[middle:], dim)
    return left[0] + right[0], left[1] + right[1]


def _slices(batch: pa.Array, size: int, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """A batch in parts of at most `size` texts, of at most `most` bytes up to their last one."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(batch), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    start = 0
    while start < len(batch):
        before = upto[start - 1] if start else 0
        end = min(start + size, len(batch), int(np.searchsorted(upto, before + most)) + 1)
        yield batch.slice(start, end - start)
        start = end


def embedding_udf(provider: Provider, dim: int, batch_size: int):
    @F.arrow_udf("struct<embedding: array<float>, error: string>")
    def embed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            if not len(batch):
                yield _as_struct([], [])
            for some in _slices(batch, batch_size):
                yield _as_struct(*_vectors(provider, some.to_pylist(), dim))

    # Declared so that Catalyst does not run the model a second time in a filter
    # on its result that it pushes below this step.
    return embed.asNondeterministic()


def _as_struct(vectors, errors) -> pa.Array:
    good = [v for v in vectors if v is not None]
    flat = np.concatenate(good) if good else np.zeros(0, np.float32)
    sizes = np.array([0 if v is None else len(v) for v in vectors])
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    missing = pa.array([v is None for v in vectors], pa.bool_())
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=missing)
    return pa.StructArray.from_arrays([lists, pa.array(errors, pa.string())], ["embedding", "error"])


def embed(
    rows: DataFrame, provider: Provider | None = None, dim: int = HASH_DIM,
    text: str = "content", batch_size: int = 256,
) -> DataFrame:
    """Add `embedding` and `error`. Both are null where the text is.

    Only the text crosses to Python. A row whose text cannot be embedded keeps
    its place with an error, and the rest of its batch is unharmed.
    """
    model = embedding_udf(provider, dim, batch_size) if provider else _hashing(dim, batch_size)
    made = model(F.col(text))
    return rows.withColumn("_made", made).select(
        *rows.columns, F.col("_made.embedding").alias("embedding"), F.col("_made.error").alias("error")
    )


@cache
def _hashing(dim: int, batch_size: int):
    """Made once, since a function is shipped with the code that it needs."""
    return embedding_udf(HashProvider(dim), dim, batch_size)


def hash_vector(text: Column, dim: int = HASH_DIM) -> Column:
    return embedding_udf(HashProvider(dim), dim, 256)(text)["embedding"]


def dimension_rejects(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows the vector table would refuse, with the dimension they have."""
    return vectors.filter(~has_dimension(F.col(column), dim)).withColumn(
        "dimensions", F.size(column)
    )
