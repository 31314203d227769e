"""Same-key replay of keyed token sampling (exponential scheme).

Tokens, ids and windows are native expressions. Keyed hashing is done in one Arrow pass per text, so the key travels with the
function and is never part of a plan, a log or a report, and no token is exchanged.
"""

from __future__ import annotations

import hashlib
import hmac
import math
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as C

REPORT = "tokens_total int, skipped_no_context int, skipped_repeated int, counted int, statistic double, p_value double, score double, is_watermarked boolean"


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), 0)


def token_ids(found: Column) -> Column:
    """Ids as 16 hex digits: the first eight bytes of each token's SHA-256."""
    return F.transform(found, lambda t: F.substring(F.sha2(t, 256), 1, 16))


def windows(docs: DataFrame, window: int = C.GUMBEL_WINDOW, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, pos, win, token_id, is_first): each position with a full window before it; later equal windows are repeats."""
    check_options(window, C.GUMBEL_THRESHOLD)
    ids = docs.select(id_col, token_ids(tokens(F.col(text))).alias("_i")).where(F.size("_i") > window)
    each = ids.select(id_col, F.explode(F.transform(F.sequence(F.lit(window), F.size("_i") - 1), lambda p: F.struct(p.alias("pos"), F.array_join(F.slice("_i", p - window + 1, window), "").alias("win"), F.get("_i", p).alias("token_id")))).alias("x"))
    each = each.select(id_col, "x.*")
    first = each.groupBy(id_col, "win").agg(F.min("pos").alias("_first"))
    return each.join(first, [id_col, "win"]).select(id_col, "pos", "win", "token_id", (F.col("pos") == F.col("_first")).alias("is_first"))


@dataclass(frozen=True)
class Key:
    """A replay key: its text, or after 0x its hex bytes. It does not show in representations."""

    raw: bytes

    @staticmethod
    def of(text: str) -> Key:
        text = text.strip()
        if text[:2].lower() != "0x":
            return Key(text.encode())
        try:
            digits = text[2:]
            if not digits or len(digits) % 2 or not digits.isalnum():
                raise ValueError
            return Key(bytes.fromhex(digits))
        except ValueError:
            raise ValueError("the key after 0x must be an even number of hex digits") from None

    def __repr__(self) -> str:
        return "Key(...)"


def check_options(window: int, threshold: float) -> None:
    if not isinstance(window, int) or isinstance(window, bool) or window < 1:
        raise ValueError("window must be an integer of 1 or more")
    if not 0 < threshold < 1:
        raise ValueError("threshold must lie between 0 and 1")


def uniform(seed: bytes, token: bytes) -> float:
    """The keyed draw of a token."""
    return (int.from_bytes(hmac.digest(seed, token, "sha256")[:8], "big") + 0.5) / 2.0**64


def gamma_survival(x: float, n: int) -> float:
    """P(Gamma(n, 1) >= x), as a sum of Poisson terms in logarithms."""
    if n <= 0 or x <= 0:
        return 1.0
    if math.isinf(x):
        return 0.0
    terms, log_x, term = [], math.log(x), -x
    for k in range(n):
        if k:
            term += log_x - math.log(k)
        terms.append(term)
    top = max(terms)
    return min(1.0, max(0.0, math.exp(top + math.log(math.fsum(math.exp(t - top) for t in terms)))))


def replay(ids: list[bytes], key: Key, window: int = C.GUMBEL_WINDOW, threshold: float = C.GUMBEL_THRESHOLD, mask_repeated: bool = True) -> dict:
    """Report of one sequence of 8-byte ids."""
    n, seen = len(ids), set()
    total, counted, repeated = 0.0, 0, 0
    for t in range(window, n):
        context = b"".join(ids[t - window : t])
        if mask_repeated and context in seen:
            repeated += 1
            continue
        seen.add(context)
        u = uniform(hmac.digest(key.raw, context, "sha256"), ids[t])
        total += math.inf if u >= 1 else -math.log1p(-u)
        counted += 1
    p = gamma_survival(total, counted)
    out = {"tokens_total": n, "skipped_no_context": min(window, n), "skipped_repeated": repeated, "counted": counted, "statistic": None, "p_value": 1.0, "score": 0.0, "is_watermarked": False}
    if counted:
        out |= {"statistic": total if math.isinf(total) else round(total, 6), "p_value": p, "score": round(-math.log10(p), 6) if p > 0 else 300.0, "is_watermarked": p < threshold}
    return out


def detect(docs: DataFrame, key: str, window: int = C.GUMBEL_WINDOW, threshold: float = C.GUMBEL_THRESHOLD, mask_repeated: bool = True, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The replay report of each text."""
    return detect_ids(docs.select(id_col, token_ids(tokens(F.col(text))).alias("_ids")), key, window, threshold, mask_repeated, id_col, "_ids")


def detect_ids(docs: DataFrame, key: str, window: int = C.GUMBEL_WINDOW, threshold: float = C.GUMBEL_THRESHOLD, mask_repeated: bool = True, id_col: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """The replay report of each sequence of ids: 16 hex digits, or decimals from 0 to 2**64 - 1."""
    check_options(window, threshold)
    secret = Key.of(key)
    kind = docs.schema[ids].dataType.elementType.simpleString()

    def code(x) -> bytes:
        if kind == "string":
            return bytes.fromhex(x)
        if not 0 <= int(x) < 1 << 64:
            raise ValueError("token ids must lie between 0 and 2**64 - 1")
        return int(x).to_bytes(8, "big")

    @F.pandas_udf(REPORT)
    def run(found: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([replay([code(x) for x in (v if v is not None else [])], secret, window, threshold, mask_repeated) for v in found])

    return docs.select(id_col, run(F.col(ids)).alias("r")).select(id_col, "r.*", F.lit(window).alias("window"), F.lit(threshold).alias("threshold"))
