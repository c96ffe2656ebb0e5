"""Frequency of every distinct term by a range-partitioned external sort and run-length scanning."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: A longest run of letters and digits.
TERM = r"[\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Composed Unicode form; plain ASCII passes through."""
    return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFC", x))


def term_pairs(df: DataFrame, text: Column, record: Column) -> DataFrame:
    """term, record (binary), n: how often the term occurs in the record's row. Null and blank texts have no terms.

    Record ids that are 64 hexadecimal digits are kept as their 32 bytes, other ids as their UTF-8 bytes.
    """
    compact = F.when(record.rlike("^[0-9a-f]{64}$"), F.unhex(record)).otherwise(F.encode(record, "UTF-8"))
    terms = F.regexp_extract_all(nfc(F.lower(text)), F.lit(TERM), F.lit(0))
    return (
        df.where(record.isNotNull() & text.isNotNull())
        .select(compact.alias("record"), terms.alias("terms"))
        .select("record", F.explode(F.transform(F.array_distinct("terms"), lambda t: F.struct(t.alias("term"), F.size(F.filter("terms", lambda u: u == t)).cast("long").alias("n")))).alias("t"))
        .select("t.term", "record", "t.n")
    )


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of equal terms in sorted (term, record, n) rows: term, occurrences, records. A run that goes over batches is one."""
    term, last, occ, recs = None, None, 0, 0
    for b in batches:
        if not b.num_rows:
            continue
        t, r, n = b.column(0), b.column(1), b.column(2).to_numpy()
        new_term = np.ones(b.num_rows, bool)
        new_rec = np.ones(b.num_rows, bool)
        if b.num_rows > 1:
            new_term[1:] = pc.not_equal(t.slice(1), t.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
            new_rec[1:] = new_term[1:] | pc.not_equal(r.slice(1), r.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
        goes_on = term is not None and t[0].as_py() == term
        new_term[0] = not goes_on
        new_rec[0] = not (goes_on and r[0].as_py() == last)
        starts = np.flatnonzero(new_term)
        edges = np.concatenate([[0], starts[starts > 0], [b.num_rows]])
        occs, rs = np.add.reduceat(n, edges[:-1]), np.add.reduceat(new_rec.astype(np.int64), edges[:-1])
        names = t.take(pa.array(edges[:-1])).to_pylist()
        if goes_on:
            occs[0], rs[0] = occs[0] + occ, rs[0] + recs
        elif term is not None:
            names, occs, rs = [term, *names], np.concatenate([[occ], occs]), np.concatenate([[recs], rs])
        term, occ, recs, last = names[-1], int(occs[-1]), int(rs[-1]), r[b.num_rows - 1].as_py()
        if len(names) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(names[:-1], pa.string()), pa.array(occs[:-1], pa.int64()), pa.array(rs[:-1], pa.int64())], ["term", "occurrences", "records"])
    if term is not None:
        yield pa.RecordBatch.from_arrays([pa.array([term]), pa.array([occ], pa.int64()), pa.array([recs], pa.int64())], ["term", "occurrences", "records"])


def term_frequencies(pairs: DataFrame) -> DataFrame:
    """term, occurrences, records of ``pairs`` (term, record, n).

    Ranges of (term, record) are sorted, spilling as they need, and scanned for runs, so a term that stands in a third of all
    records fills many ranges. All rows of one (term, record) are in one range; the runs of a term over several ranges are summed.
    """
    runs = pairs.repartitionByRange("term", "record").sortWithinPartitions("term", "record").mapInArrow(_scan, "term string, occurrences bigint, records bigint")
    return runs.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marked(frequencies: DataFrame, total: int, rare: int = 1, common: float = 0.05) -> DataFrame:
    """``frequencies`` with ``marks``: rare (in at most ``rare`` records), common (in at least the share ``common`` of the ``total`` records), both or none."""
    marks = F.array(F.when(F.col("records") <= rare, "rare"), F.when(F.col("records") >= total * common, "common"))
    return frequencies.withColumn("marks", F.array_compact(marks))
