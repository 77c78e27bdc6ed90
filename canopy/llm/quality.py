"""Quality classifier: zstandard dictionaries of good and bad text, and the difference of the sizes they give."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import fit_isotonic, fit_logistic, labelled_sample, per_process, ship, small_batches

ship(__name__)


class Sizes:
    """Compressed sizes of a text under both dictionaries, segment by segment, so that the dictionaries count to its end."""

    def __init__(self, good: bytes, bad: bytes, level: int, segment: int):
        import zstandard as z

        self.segment = segment
        self.by = []
        for raw in (good, bad):
            d = z.ZstdCompressionDict(raw)
            d.precompute_compress(level=level)
            self.by.append(z.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False).compress)

    def features(self, text: str | None) -> tuple[float, float]:
        """(normalised size difference, log of the mean size to the text's): above 0 the bad dictionary fits better."""
        raw = (text or "").encode()
        good, bad = 0, 0
        for k in range(0, max(len(raw), 1), self.segment):
            part = raw[k : k + self.segment]
            good += len(self.by[0](part))
            bad += len(self.by[1](part))
        return (good - bad) / (good + bad), float(np.log((good + bad) / (2 * len(raw) + 20)))


def _dictionary(texts: list[str], size: int, segment: int, level: int) -> bytes:
    """Trained on all segments; of what are too few to train on, the texts themselves."""
    import zstandard as z

    parts = [raw[k : k + segment] for t in texts for raw in (t.encode(),) for k in range(0, len(raw), segment)]
    try:
        return z.train_dictionary(size, parts, level=level).as_bytes()
    except z.ZstdError:
        return b" ".join(parts)[-size:]


def fit(docs: DataFrame, labels: DataFrame, keep: Column | None = None, per_class: int = 3000, max_bytes: int = 12 << 20, size: int = 112_640, level: int = 3, segment: int = 1024) -> dict:
    """The model: two dictionaries from one half of a bounded labelled sample (per_class rows and max_bytes of text a
    class), and the calibration from the other half, weighted back to the classes' shares among all labels.

    A class without texts gives a constant score, the smoothed share of label 1.
    """
    keep = F.lit(True) if keep is None else keep
    marked = labels.filter(F.col("doc_id").isNotNull()).withColumn("_id", F.col("doc_id")).filter(keep)
    share = {r["quality"]: r["n"] for r in marked.filter(F.col("quality").isin(0, 1)).groupBy("quality").agg(F.count(F.lit(1)).alias("n")).collect()}
    prior = (share.get(1, 0) + 1) / (share.get(0, 0) + share.get(1, 0) + 2)
    rows = labelled_sample(docs, labels, "quality", keep, per_class, max_bytes)
    by = {y: [t for _, t, k in rows if k == y] for y in (0, 1)}
    if min(map(len, by.values())) < 2:
        return {"prior": prior, "version": f"prior {prior}"}
    half = {y: (ts[: len(ts) // 2], ts[len(ts) // 2 :]) for y, ts in by.items()}
    model = {"good": _dictionary(half[1][0], size, segment, level), "bad": _dictionary(half[0][0], size, segment, level), "level": level, "segment": segment}
    sizes = Sizes(**model)
    x = np.array([sizes.features(t) for y in (0, 1) for t in half[y][1]])
    y = np.array([y for y in (0, 1) for _ in half[y][1]])
    w = fit_logistic(x, y, l2=1e-5)
    weight = np.where(y == 1, share[1] / (y == 1).sum(), share[0] / (y == 0).sum())
    knots, values = fit_isotonic(w[0] + x @ w[1:], y, weight)
    model |= {"w": w, "knots": knots, "values": values}
    model["version"] = hashlib.sha256(model["good"] + model["bad"] + values.tobytes() + knots.tobytes()).hexdigest()
    return model


def score_column(docs: DataFrame, model: dict, text_col: str = "text") -> Column:
    """0 to 1, higher where label 1 is likelier, for every text; null is empty."""
    import pandas as pd

    if "prior" in model:
        return F.lit(float(model["prior"]))
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries and the knots

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = shared.value
        sizes = per_process(("quality", m["version"]), lambda: Sizes(m["good"], m["bad"], m["level"], m["segment"]))
        for batch in batches:
            x = np.array([sizes.features(t) for t in batch]).reshape(-1, 2)
            yield pd.Series(np.clip(np.interp(m["w"][0] + x @ m["w"][1:], m["knots"], m["values"]), 0, 1))

    return F.pandas_udf(run, "double", F.PandasUDFType.SCALAR_ITER)(F.col(text_col))
