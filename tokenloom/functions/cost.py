"""Cost arithmetic.

Per call: ``tokens`` as decimal(18,0) times the price as decimal(12,8),
rounded once (HALF_UP) to the stored decimal(10,6); sums are taken over the
rounded values, as the stored per-task column implies.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tokenloom.schemas import COST_TYPE


def cost_expr(in_tokens: Column, out_tokens: Column, price_in: Column, price_out: Column) -> Column:
    exact = (in_tokens.cast("decimal(18,0)") * price_in.cast("decimal(12,8)")
             + out_tokens.cast("decimal(18,0)") * price_out.cast("decimal(12,8)"))
    return F.coalesce(exact.cast(COST_TYPE), F.lit(0).cast(COST_TYPE))
