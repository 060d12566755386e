"""Named seeds: a hash of root, domain and draw, so that streams never share numbers."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.types import LongType


#: The names under which streams are drawn; ``design_seed`` takes others too.
SEED_DOMAINS = frozenset({"stat_pool", "du_pool", "fixed", "resample_pool", "input_strat", "hazard_select_stat", "hazard_select_du", "etest:kn", "etest:hmm", "cv_axis"})


def design_seed(root: int, domain: str, draw: int = 0) -> int:
    """BLAKE2b with 8 bytes over ``root|domain|draw``, modulo 2**31 - 1."""
    return int.from_bytes(hashlib.blake2b(f"{root}|{domain}|{draw}".encode(), digest_size=8).digest(), "big") % (2**31 - 1)


@F.arrow_udf(LongType())
def design_seed_column(root: pa.Array, domain: pa.Array, draw: pa.Array) -> pa.Array:
    """``design_seed`` of three columns, an Arrow batch at a time."""
    return pa.array([design_seed(*x) for x in zip(root.to_pylist(), domain.to_pylist(), draw.to_pylist(), strict=True)], pa.int64())


def child_seeds(root: int, n: int) -> list[np.random.SeedSequence]:
    """n independent streams; stream k does not depend on n, so it belongs to the row's index, never to a partition."""
    return np.random.SeedSequence(root).spawn(n)
