"""The scored-row sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiver.functions.labels import LABEL_CAP, clip
from quiver.operators.features import hash_slot


def scored_rows(df: DataFrame, tasks: Mapping[str, tuple[str, str]], split: str,
                id_cols: Sequence[str], label_cols: Sequence[str], extra_cols: Sequence[str] = (),
                with_clock: bool = True) -> DataFrame:
    """One row per sample: per task its score, raw label, the ``_cap``
    label (clipped to 0..300) and the score again under ``_cap``; the ids; the
    label columns; ``dataset`` = split; request time; a mock user 0."""
    out = [F.lit(split).alias("dataset"), F.lit(0).cast("bigint").alias("user_id_mock")]
    if with_clock:
        out.append(F.current_timestamp().alias("req_time"))
    for task, (lab, score) in tasks.items():
        out += [F.col(score).cast("double").alias(f"score_{task}"),
                F.col(lab).cast("double").alias(f"label_{task}"),
                F.col(score).cast("double").alias(f"score_{task}_cap"),
                clip(lab, *LABEL_CAP).alias(f"label_{task}_cap")]
    out += [F.col(c) for c in id_cols] + [F.col(c) for c in label_cols] + [F.col(c) for c in extra_cols]
    return df.select(*out)


def sample_by_hash(df: DataFrame, key_cols: Sequence[str], ratio: float, portable: bool = False) -> DataFrame:
    """Deterministic row sample (the service's sampling ratio): keep rows whose
    key hash falls in the first ``ratio`` share of 1000 slots. ``portable``
    hashes the keys' texts, joined by ``|``, by MD5."""
    k = int(round(ratio * 1000))
    if portable:
        return df.filter(hash_slot(F.concat_ws("|", *key_cols), 1000, portable=True) < k)
    return df.filter(F.pmod(F.xxhash64(*[F.col(c) for c in key_cols]), F.lit(1000)) < k)


def write_scored(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """S10 sink: Parquet partitioned by ``dataset`` (train / eval). Overwriting
    replaces the partitions that ``df`` holds and leaves the others, so the
    train and the eval run can write one after the other."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("dataset").parquet(path)
