"""Schemas of files and events the jobs read."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _D, _L, _I, _B = T.StringType(), T.DoubleType(), T.LongType(), T.IntegerType(), T.BooleanType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


QUOTE_EXPORT_REQUIRED = ["quotationID", "productID", "quantity", "unitPrice", "salesPrice", "industry", "region", "customerID",
                         "salesRepID", "quoteDate", "leadTimeDays", "statusName", "grandTotal"]
QUOTE_EXPORT = _struct(
    quotationID=_S, productID=_S, quantity=_D, unitPrice=_D, salesPrice=_D, industry=_S, region=_S, customerID=_S, salesRepID=_S,
    quoteDate=T.DateType(), leadTimeDays=_I, statusName=_S, grandTotal=_D, listPrice=_D, negotiatedSalesPrice=_D, discountPercent=_D,
    lineTotal=_D, materialSpec=_S, productName=_S, customerName=_S, paymentTerms=_S, parentQuotationID=_S, revisionNumber=_I,
    quotationLineItemID=_S, lineNumber=_I)
SNAPSHOT_REQUIRED = ["snapshot_id", "item_id", "warehouse_id", "snapshot_date", "available_qty", "reserved_qty", "rop",
                     "demand_forecast_qty", "open_po_vendor_reliability", "stockout_flag"]
EVENT = _struct(topic=_S, tenant=_S, payload=T.MapType(_S, _S), label=_S, ts=_D)
EVENT_ROW = _struct(event_id=_L, ts=T.TimestampNTZType(), user_id=_L, event_type=_S, value=_D, props=_S)
SNAPSHOT_SCHEMA, OUTCOME_SCHEMA = "m3.snapshot.v1", "m3.outcome.v1"
SNAPSHOT_RECORD = T.StructType([
    T.StructField("schema", _S), T.StructField("tenant", _S), T.StructField("job_id", _S), T.StructField("scored_at", _S),
    T.StructField("delay_threshold", _D),
    T.StructField("operations", T.ArrayType(_struct(operation_id=_S, status=_S, time_overrun_ratio=_S, material_shortfall_ratio=_S))),
    T.StructField("insight", _struct(status=_S, is_delayed=_B)), T.StructField("_corrupt_record", _S)])
