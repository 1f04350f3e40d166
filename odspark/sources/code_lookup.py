"""Standard-code lookup from stop-API JSON responses, as a table op.

The original calls the API once per ARS and takes the first element's
``sttnId`` (NULL on an empty array or any error). Here the responses are a
column: ``from_json`` parses every body in the executors (malformed text
gives NULL), ``get`` returns NULL for an empty array instead of raising.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESPONSE_SCHEMA = "array<struct<sttnId:string>>"


def first_station_id(body) -> "F.Column":
    arr = F.from_json(F.col(body) if isinstance(body, str) else body, RESPONSE_SCHEMA)
    return F.get(arr, 0).getField("sttnId")


def parse_code_responses(resp: DataFrame, ars: str = "ars", body: str = "body") -> DataFrame:
    """(ars, body) -> (ars, code)."""
    return resp.select(F.col(ars).alias("ars"), first_station_id(body).alias("code"))
