"""SQL definitions of the proxy views, for the side-by-side check only."""

from __future__ import annotations

import re

VIEWS: dict[str, str] = {}

VIEWS["quotes"] = """
SELECT o_orderkey AS quotationID, o_custkey AS customerID, o_orderpriority AS salesRepID,
       c_mktsegment AS industry, r_name AS region, CAST(o_orderdate AS DATE) AS quoteDate,
       o_orderkey % 45 AS leadTimeDays,
       CASE o_orderstatus WHEN 'F' THEN 'Closed Won' WHEN 'P' THEN 'Closed Lost' ELSE 'Sent' END AS statusName,
       o_totalprice AS grandTotal,
       CASE WHEN o_orderkey % 5 IN (1, 2) THEN o_orderkey - 1 END AS parentQuotationID,
       CASE WHEN o_orderkey % 5 <= 2 THEN o_orderkey % 5 + 1 ELSE 1 END AS revisionNumber,
       CASE o_orderkey % 3 WHEN 0 THEN 'Immediate Payment' WHEN 1 THEN '15 days' ELSE '21 days' END AS paymentTerms
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey"""

VIEWS["quote_lines"] = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS quotationLineItemID,
       l_orderkey AS quotationID, l_linenumber AS lineNumber, l_partkey AS productID, l_quantity AS quantity,
       p_retailprice AS unitPrice, floor(l_extendedprice * (1 - l_discount) / l_quantity * 100 + 0.5) / 100 AS salesPrice,
       CASE WHEN l_linenumber % 4 = 0 THEN floor(l_extendedprice * (1 - l_discount) / l_quantity * 97 + 0.5) / 100 END AS negotiatedSalesPrice,
       1.67 * p_retailprice AS listPrice, l_discount * 100 AS discountPercent, p_type AS materialSpec, p_name AS productName
FROM lineitem JOIN part ON l_partkey = p_partkey"""

VIEWS["families"] = """
SELECT quotationID, quotationID AS root FROM quotes WHERE parentQuotationID IS NULL
UNION ALL
SELECT q.quotationID, f.root FROM quotes q JOIN families f ON q.parentQuotationID = f.quotationID"""

VIEWS["finals"] = """
SELECT root, arg_max(quotationID, (revisionNumber, quotationID)) AS quotationID
FROM quotes JOIN families USING (quotationID) GROUP BY root"""

VIEWS["decided"] = """
SELECT * FROM (
  SELECT q.*, CASE WHEN statusName = 'Closed Won' THEN 1.0::DOUBLE WHEN statusName = 'Closed Lost' THEN 0.0
                   WHEN datediff('day', quoteDate, (SELECT max(quoteDate) FROM quotes JOIN finals USING (quotationID))) >= 60 THEN 0.0 END AS won
  FROM quotes q JOIN finals USING (quotationID)) WHERE won IS NOT NULL"""

VIEWS["headers"] = """
SELECT d.*, (coalesce(c.w, 0) + 3 * g.g) / (coalesce(c.n, 0) + 3) AS contact_win_rate,
       (coalesce(s.w, 0) + 3 * g.g) / (coalesce(s.n, 0) + 3) AS salesrep_win_rate
FROM decided d, (SELECT avg(won) AS g FROM decided) g,
LATERAL (SELECT sum(p.won) AS w, count(p.won) AS n FROM decided p WHERE p.customerID = d.customerID AND p.quoteDate < d.quoteDate) c,
LATERAL (SELECT sum(p.won) AS w, count(p.won) AS n FROM decided p WHERE p.salesRepID = d.salesRepID AND p.quoteDate < d.quoteDate) s"""

VIEWS["priced"] = """
SELECT *, coalesce(negotiatedSalesPrice, salesPrice) AS effective_price,
       coalesce(negotiatedSalesPrice, salesPrice) / nullif(listPrice, 0) AS price_ratio,
       quantity * coalesce(negotiatedSalesPrice, salesPrice) AS amt
FROM quote_lines"""

VIEWS["rollup"] = """
SELECT quotationID, sum(quantity) AS total_quantity, count(*) AS line_count, count(DISTINCT productID) AS n_products,
       avg(price_ratio) AS mean_price_ratio, min(price_ratio) AS min_price_ratio,
       CASE WHEN sum(amt) > 0 THEN sum(coalesce(price_ratio, 1.0) * amt) / sum(amt) ELSE avg(price_ratio) END AS wtd_price_ratio,
       (1 - coalesce(avg(price_ratio), 1.0)) * 100 AS avg_discount_pct
FROM priced GROUP BY quotationID"""

_WORD = re.compile(r"[A-Za-z_][A-Za-z_0-9]*")


def steady_round(sql: str) -> str:
    """Write ``round(x, n)`` so that exact ties fall the same way in both engines."""
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, end, comma = 1, at + 6, -1
        while depth:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 1:
                comma = end
            end += 1
        inner = sql[at + 6:comma if comma >= 0 else end - 1]
        if comma >= 0:
            n = sql[comma + 1:end - 1].strip()
            out += f"{sql[i:at]}(floor(({steady_round(inner)}) * 1e{n} + 0.50001) / 1e{n})"
        else:
            out += f"{sql[i:at]}round({steady_round(inner)})"
        i = end
    return out + sql[i:]


def with_views(sql: str) -> str:
    """Put the definitions of every view the statement uses in front of it."""
    sql = steady_round(sql)
    needed: list[str] = []

    def visit(text: str) -> None:
        for word in _WORD.findall(text):
            if word in VIEWS and word not in needed and word not in visiting:
                visiting.add(word)
                visit(VIEWS[word])
                needed.append(word)

    visiting: set[str] = set()
    visit(sql)
    if not needed:
        return sql.strip()
    heads = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in needed)
    body = sql.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {heads}, {body[15:]}"
    if body.upper().startswith("WITH "):
        return f"WITH RECURSIVE {heads}, {body[5:]}"
    return f"WITH RECURSIVE {heads} {body}"

VIEWS["snapshots"] = """
SELECT concat_ws('-', item_id, strftime(snapshot_date, '%Y%m%d')) AS snapshot_id, item_id, item_id % 3 AS warehouse_id, snapshot_date,
       all_qty AS available_qty, q1 * 0.5 AS reserved_qty, (20 + item_id % 30)::DOUBLE AS rop, all_qty * 0.8 AS demand_forecast_qty,
       qn AS open_qty, CASE WHEN item_id % 7 <> 0 THEN snapshot_date + CAST(item_id % 21 AS INTEGER) END AS open_po_deadline,
       CASE WHEN item_id % 11 <> 0 THEN rel END AS open_po_vendor_reliability, r_share > 0.5 AS stockout_flag, q7 AS past_due_qty,
       5.0 * n6 AS planned_bom_qty, (7 + item_id % 10)::DOUBLE AS lead_time_days, (item_id % 4 * 10)::DOUBLE AS external_risk_pct,
       CASE WHEN item_id % 3 = 0 THEN 'Draft' ELSE 'Not Applicable' END AS draft_mo_status, q5 AS draft_mo_required_qty,
       CASE item_id % 4 WHEN 0 THEN 'Confirmed' WHEN 1 THEN 'In Progress' WHEN 2 THEN 'Not Applicable' ELSE 'Done' END AS mo_status,
       q3 AS consumed_qty, CASE WHEN item_id % 13 <> 0 THEN (item_id % 12)::DOUBLE END AS months_of_history, item_id % 17 = 0 AS use_rule_based,
       CASE WHEN item_id % 2 = 0 THEN 0.97 END AS calculated_vendor_reliability, item_id % 5 = 0 AS business_scenario_injected
FROM (SELECT l_suppkey AS item_id, CAST(date_trunc('week', l_shipdate) AS DATE) AS snapshot_date, sum(l_quantity) AS all_qty,
  sum(CASE WHEN l_linenumber = 1 THEN l_quantity ELSE 0 END) AS q1, sum(CASE WHEN l_linenumber = 3 THEN l_quantity ELSE 0 END) AS q3,
  sum(CASE WHEN l_linenumber = 5 THEN l_quantity ELSE 0 END) AS q5, sum(CASE WHEN l_linenumber = 7 THEN l_quantity ELSE 0 END) AS q7,
  count(CASE WHEN l_linenumber = 6 THEN 1 END) AS n6, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) AS qn,
  count(CASE WHEN l_discount >= 0.05 THEN 1 END) / count(*) AS rel, count(CASE WHEN l_returnflag = 'R' THEN 1 END) / count(*) AS r_share
  FROM lineitem GROUP BY 1, 2)"""

VIEWS["engineered"] = """
SELECT * REPLACE (CASE WHEN open_qty > 0 THEN open_po_deadline END AS open_po_deadline, CASE WHEN open_qty > 0 THEN open_po_vendor_reliability END AS open_po_vendor_reliability,
       CASE WHEN external_risk_pct > 0 THEN lead_time_days * (1 + external_risk_pct / 100) ELSE lead_time_days END AS lead_time_days),
       available_qty - (demand_forecast_qty / 4 + planned_bom_qty + past_due_qty) AS projected_without_po,
       available_qty + open_qty - (demand_forecast_qty / 4 + planned_bom_qty + past_due_qty) AS projected_with_po,
       available_qty / nullif(rop, 0) AS inventory_to_rop_ratio, greatest(draft_mo_required_qty - available_qty, 0) AS draft_mo_shortage_qty,
       available_qty / nullif(draft_mo_required_qty, 0) AS draft_mo_coverage_ratio,
       greatest(greatest(consumed_qty - reserved_qty, 0) - greatest(available_qty - reserved_qty, 0), 0) AS material_shortfall_qty,
       consumed_qty / nullif(reserved_qty, 0) AS consumption_to_reservation_ratio,
       CASE WHEN open_qty > 0 THEN datediff('day', snapshot_date, open_po_deadline) END::DOUBLE AS days_until_po_delivery
FROM snapshots"""

VIEWS["targets"] = """
SELECT snapshot_id, item_id, warehouse_id, snapshot_date, stockout_flag, CASE WHEN g1 THEN f1 END AS target, CASE WHEN n4 = 4 THEN any4 END AS target_4w, CASE WHEN n9 = 9 THEN any9 END AS target_9w
FROM (SELECT a.snapshot_id, any_value(a.item_id) AS item_id, any_value(a.warehouse_id) AS warehouse_id, any_value(a.snapshot_date) AS snapshot_date, any_value(a.stockout_flag) AS stockout_flag,
  coalesce(bool_or(datediff('day', a.snapshot_date, b.snapshot_date) = 7), false) AS g1, bool_or(b.stockout_flag) FILTER (datediff('day', a.snapshot_date, b.snapshot_date) = 7) AS f1,
  count(b.snapshot_id) FILTER (datediff('day', a.snapshot_date, b.snapshot_date) <= 28) AS n4, bool_or(b.stockout_flag) FILTER (datediff('day', a.snapshot_date, b.snapshot_date) <= 28) AS any4,
  count(b.snapshot_id) AS n9, bool_or(b.stockout_flag) AS any9
  FROM snapshots a LEFT JOIN snapshots b ON a.item_id = b.item_id AND a.warehouse_id = b.warehouse_id AND b.snapshot_date > a.snapshot_date AND b.snapshot_date <= a.snapshot_date + 63 GROUP BY 1)"""

VIEWS["items"] = """
SELECT p_partkey AS id, p_name AS item_name, p_type AS item_type, p_size::DOUBLE AS rop, CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 5 END AS default_warehouse_id,
       p_size * 3.0::DOUBLE AS available_quantity, (p_partkey % 100)::DOUBLE AS forecasted_quantity,
       CASE p_partkey % 4 WHEN 0 THEN '{"demand_forecast_qty": 40}' WHEN 1 THEN '{"inventory": {"past_due_qty": 7}}' WHEN 2 THEN '{"ai_inventory": {"external_risk_pct": 20}}' END AS custom_elements FROM part"""
VIEWS["item_vendors"] = """
SELECT l_partkey AS item_id, l_suppkey AS id, l_suppkey AS vendor_id, min(l_shipdate) AS created_at, l_suppkey % 30 AS lead_time_days FROM lineitem GROUP BY l_partkey, l_suppkey"""
VIEWS["pos"] = """
SELECT o_orderkey AS id, o_custkey % 100 AS vendor_id, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 5 END AS warehouse_id, o_orderdate + INTERVAL 60 DAY AS scheduled_delivery_date,
       CASE o_orderstatus WHEN 'F' THEN 'Received' WHEN 'P' THEN 'Confirmed' ELSE 'Sent' END AS status, o_orderdate AS created_at FROM orders"""
VIEWS["po_lines"] = """
SELECT l_orderkey AS purchase_order_id, l_partkey AS item_id, l_quantity AS ordered_quantity, CASE WHEN l_linestatus = 'F' THEN l_quantity ELSE floor(l_quantity / 2) END AS received_quantity FROM lineitem"""
VIEWS["grns"] = """
SELECT l_orderkey AS purchase_order_id, l_suppkey AS vendor_id, o_orderdate + INTERVAL 60 DAY AS scheduled_delivery_date,
       CASE l_returnflag WHEN 'R' THEN 'Goods Received' WHEN 'A' THEN 'Partially Received' ELSE 'Pending' END AS status, l_shipdate AS updated_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"""
VIEWS["mos"] = """
SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'Draft' WHEN 1 THEN 'Confirmed' WHEN 2 THEN 'In Progress' WHEN 3 THEN 'Done' ELSE 'Cancelled' END AS status, o_orderkey % 5 AS warehouse_id FROM orders"""
VIEWS["mo_components"] = """
SELECT l_orderkey AS mo_id, l_partkey AS item_id, l_quantity AS required_qty, l_quantity * 0.5 AS reserved_qty, l_quantity * 0.75 AS consumed_qty FROM lineitem"""
VIEWS["vendor_history"] = """
SELECT vendor_id, count(*) AS total, count(CASE WHEN received <= deadline THEN 1 END) AS on_time, count(*) - count(CASE WHEN received <= deadline THEN 1 END) AS late, min(received) AS earliest,
       count(CASE WHEN received <= deadline THEN 1 END) / count(*) AS reliability
FROM (SELECT vendor_id, purchase_order_id, max(scheduled_delivery_date) AS deadline, max(updated_at) AS received FROM grns WHERE lower(status) LIKE '%received%' GROUP BY 1, 2) GROUP BY 1"""
VIEWS["open_lines"] = """
SELECT l.item_id, p.vendor_id, p.warehouse_id, p.scheduled_delivery_date, greatest(ordered_quantity - received_quantity, 0) AS open_qty FROM po_lines l JOIN pos p ON l.purchase_order_id = p.id
WHERE lower(p.status) NOT IN ('closed', 'cancelled', 'canceled', 'goods received', 'received', 'partially received - closed') AND ordered_quantity - received_quantity > 0"""
VIEWS["preferred"] = """
SELECT * FROM (SELECT l.*, i.default_warehouse_id, coalesce(l.warehouse_id IS NULL OR l.warehouse_id = i.default_warehouse_id, false) AS here,
  bool_or(coalesce(l.warehouse_id IS NULL OR l.warehouse_id = i.default_warehouse_id, false)) OVER (PARTITION BY l.item_id) AS any_here
  FROM open_lines l JOIN items i ON i.id = l.item_id) WHERE here OR NOT any_here"""
VIEWS["open_rollup"] = """
SELECT item_id, sum(open_qty) AS open_qty, min(scheduled_delivery_date) AS open_po_deadline, sum(reliability * open_qty) / sum(CASE WHEN reliability IS NOT NULL THEN open_qty END) AS open_po_vendor_reliability
FROM preferred LEFT JOIN vendor_history USING (vendor_id) GROUP BY 1"""
VIEWS["demand"] = """
SELECT item_id, count(CASE WHEN status = 'Draft' THEN 1 END) > 0 AS has_draft, sum(CASE WHEN status = 'Draft' THEN required_qty END) AS draft_qty,
       sum(CASE WHEN status IN ('Confirmed', 'In Progress') THEN reserved_qty END) AS reserved_qty, sum(CASE WHEN status IN ('Confirmed', 'In Progress') THEN consumed_qty END) AS consumed_qty,
       CASE WHEN count(CASE WHEN status = 'In Progress' THEN 1 END) > 0 THEN 'In Progress' WHEN count(CASE WHEN status = 'Confirmed' THEN 1 END) > 0 THEN 'Confirmed' ELSE 'Not Applicable' END AS mo_status
FROM mo_components LEFT JOIN mos ON mo_id = mos.id GROUP BY 1"""

VIEWS["scored"] = """
SELECT quotationLineItemID AS id, quotationID, productID, materialSpec, quantity, unitPrice, price_ratio, discountPercent,
       floor(10000 / (1 + price_ratio) + 0.5) / 10000 AS p, floor(10000 / (1 + price_ratio * 1.3 + discountPercent / 10) + 0.5) / 10000 AS p2,
       CASE WHEN price_ratio < 1 AND quotationID % 3 <> 0 OR lineNumber = 2 THEN 1 ELSE 0 END AS y
FROM priced"""
VIEWS["tenant_signals"] = """
SELECT c_custkey AS tenant, s.ord, s.signal, s.prior_bp, s.min_bp, s.max_bp, (c_custkey + s.ord) % 4 <> 0 AND c_custkey % 50 <> 7 AS available,
       f.prior_bp AS fitted_bp, CASE s.ord WHEN 0 THEN c_custkey * 37 % 3000 WHEN 1 THEN -(c_custkey * 37 % 3000) WHEN 3 THEN c_custkey * 11 % 900 WHEN 4 THEN -(c_custkey * 11 % 900) ELSE 0 END AS adjust_bp
FROM customer CROSS JOIN (VALUES (0, 'time_overrun', 4000, 3000, 5000), (1, 'operator_skill', 3500, 2000, 4500), (2, 'seasonality', 1000, 500, 2000), (3, 'material_availability', 1000, 500, 2500), (4, 'supplier_reliability', 500, 300, 1500)) s(ord, signal, prior_bp, min_bp, max_bp)
JOIN (VALUES (0, 4000), (1, 3500), (2, 1000), (3, 1000), (4, 500)) f(ord, prior_bp) ON f.ord = (s.ord + c_custkey) % 5"""

VIEWS["work_orders"] = """
SELECT *, job_id || '-' || seq AS operation_id, CASE WHEN seq > 1 THEN 'DEPENDENT' ELSE 'INDEPENDENT' END AS operation_type,
       CASE WHEN pc = 0 THEN 'PENDING' WHEN pc = 10 THEN 'DONE' ELSE 'IN_PROGRESS' END AS status, CASE WHEN pc = 10 THEN shipdate END AS actual_end,
       CASE WHEN pc = 0 THEN CASE WHEN operator % 2 = 0 THEN 0 END ELSE floor(expected * pc * (6 + operator % 10) / 100) * CASE WHEN item_id % 101 = 0 THEN 30 ELSE 1 END END AS actual,
       CASE step_id WHEN 1 THEN 'Cutting' WHEN 2 THEN 'Milling 2' WHEN 3 THEN 'Welding' WHEN 4 THEN 'Assembly' WHEN 6 THEN 'Paint 6' WHEN 7 THEN 'Inspection' END AS operation_name
FROM (SELECT l_orderkey AS job_id, l_linenumber AS step_id, l_partkey AS item_id, l_suppkey AS operator, l_shipdate AS shipdate, l_quantity AS job_quantity, l_partkey % 11 AS pc,
  60 + 10 * l_quantity AS expected, floor(l_quantity * (l_partkey % 11) / 10) AS done_quantity, lid,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, md5(lid), lid) AS seq
  FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS lid FROM lineitem))"""
VIEWS["wo_operators"] = """
SELECT job_id, operation_id, operation_type, step_id, expected, actual, actual_end, unnest(CASE WHEN step_id % 2 = 0 THEN [operator, operator + 7] ELSE [operator] END) AS operator_id FROM work_orders"""
VIEWS["time_logs"] = """
SELECT operation_id, operator_id, floor(actual / 2) AS duration_minutes FROM wo_operators WHERE actual IS NOT NULL
UNION ALL SELECT operation_id, operator_id, floor(actual / 4) FROM wo_operators WHERE actual IS NOT NULL AND step_id % 3 = 0"""
VIEWS["edges"] = """
SELECT w.job_id, w.operation_id, w.job_id || '-' || p AS pred_id FROM (
  SELECT job_id, operation_id, unnest(list_filter([CASE WHEN seq % 2 = 0 THEN seq - 1 END, CASE WHEN seq % 2 = 1 AND seq > 1 THEN seq - 2 END, CASE WHEN seq % 4 = 0 THEN seq - 3 END,
    CASE WHEN seq = 2 AND job_id % 10 = 0 THEN 99 END, CASE WHEN seq = 1 AND job_id % 97 = 0 THEN 2 END], lambda x: x IS NOT NULL)) AS p FROM work_orders) w"""
VIEWS["operator_last"] = """
SELECT * FROM (SELECT o.operator_id, o.operation_id, o.expected, o.actual_end, row_number() OVER (PARTITION BY o.operator_id ORDER BY o.actual_end DESC NULLS LAST, o.operation_id) AS rn FROM wo_operators o) WHERE rn <= 10"""
VIEWS["operator_pace"] = """
SELECT l.operator_id, avg(CASE WHEN actual_end IS NOT NULL AND expected <> 0 THEN coalesce(m.elapsed, 0) / expected END) AS pace, count(CASE WHEN actual_end IS NOT NULL AND expected <> 0 THEN 1 END) AS completed
FROM operator_last l LEFT JOIN (SELECT operation_id, operator_id, sum(duration_minutes) AS elapsed FROM time_logs GROUP BY 1, 2) m ON m.operation_id = l.operation_id AND m.operator_id = l.operator_id GROUP BY 1"""
VIEWS["vendor_pos"] = """
SELECT *, CASE WHEN l_linenumber % 2 = 1 THEN created_at + INTERVAL 1 DAY ELSE created_at END AS ordered, created_at + INTERVAL 60 DAY AS deadline, CASE WHEN l_returnflag IN ('R', 'A') AND l_shipdate >= created_at THEN l_shipdate END AS received FROM (
 SELECT p.lid AS po_id, p.l_partkey AS item_id, p.l_suppkey AS vendor_id, o_orderdate AS created_at, p.l_linenumber, p.l_returnflag, p.l_shipdate,
 row_number() OVER (PARTITION BY p.l_partkey ORDER BY o_orderdate DESC, p.lid DESC) AS rn
 FROM (SELECT *, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS lid FROM lineitem) p JOIN orders ON o_orderkey = l_orderkey
 JOIN (SELECT item_id, arg_min(vendor_id, (created_at, id)) AS v FROM item_vendors GROUP BY 1) f ON f.item_id = p.l_partkey AND f.v = p.l_suppkey) WHERE rn <= 10"""
VIEWS["vendor_ratio"] = """
SELECT item_id, any_value(vendor_id) AS vendor_id, avg(CASE WHEN received IS NOT NULL AND deadline <> ordered THEN (epoch_us(received) - epoch_us(ordered)) / (epoch_us(deadline) - epoch_us(ordered)) END) AS ratio FROM vendor_pos GROUP BY 1"""
VIEWS["components"] = """
SELECT w.job_id, w.lid, w.item_id AS component_id, p_name || ' ' || p_size AS name, w.job_quantity AS required, CASE WHEN w.item_id % 13 = 0 THEN 0 ELSE p_size END::DOUBLE AS available, v.ratio AS vendor_ratio, s_name AS vendor_name
FROM work_orders w JOIN part ON p_partkey = w.item_id LEFT JOIN vendor_ratio v ON v.item_id = w.item_id LEFT JOIN supplier ON s_suppkey = v.vendor_id WHERE p_partkey % 50 <> 0"""
VIEWS["cpm_forward"] = """
SELECT job_id, operation_id, 0.0::DOUBLE AS es, 0 AS depth FROM work_orders WHERE job_id % 97 <> 0 OR job_id NOT IN (SELECT job_id FROM work_orders WHERE seq = 2)
UNION ALL SELECT e.job_id, e.operation_id, f.es + w.expected, f.depth + 1 FROM cpm_forward f JOIN edges e ON e.job_id = f.job_id AND e.pred_id = f.operation_id JOIN work_orders w ON w.operation_id = f.operation_id"""
VIEWS["cpm_backward"] = """
SELECT job_id, operation_id, 0.0::DOUBLE AS tail, 0 AS depth FROM work_orders WHERE job_id % 97 <> 0 OR job_id NOT IN (SELECT job_id FROM work_orders WHERE seq = 2)
UNION ALL SELECT e.job_id, e.pred_id, f.tail + w.expected, f.depth + 1 FROM cpm_backward f JOIN edges e ON e.job_id = f.job_id AND e.operation_id = f.operation_id JOIN work_orders w ON w.operation_id = f.operation_id
 JOIN work_orders x ON x.operation_id = e.pred_id"""
VIEWS["cpm"] = """
SELECT w.job_id, w.operation_id, f.es IS NOT NULL AS valid, coalesce(p.project, 0) AS project, f.es, f.es + w.expected AS ef, p.project - b.tail - w.expected AS ls, p.project - b.tail AS lf,
       CASE WHEN f.es IS NOT NULL THEN greatest(p.project - b.tail - w.expected - f.es, 0) END AS float_minutes, coalesce(abs(p.project - b.tail - w.expected - f.es) <= 1e-7, false) AS critical
FROM work_orders w LEFT JOIN (SELECT operation_id, max(es) AS es FROM cpm_forward GROUP BY 1) f ON f.operation_id = w.operation_id
LEFT JOIN (SELECT operation_id, max(tail) AS tail FROM cpm_backward GROUP BY 1) b ON b.operation_id = w.operation_id
LEFT JOIN (SELECT x.job_id, max(c.es + x.expected) AS project FROM cpm_forward c JOIN work_orders x ON x.operation_id = c.operation_id GROUP BY 1) p ON p.job_id = w.job_id"""
VIEWS["critical_edges"] = """
SELECT DISTINCT e.job_id, e.operation_id, e.pred_id FROM edges e JOIN cpm a ON a.operation_id = e.operation_id AND a.critical JOIN cpm b ON b.operation_id = e.pred_id AND b.critical WHERE abs(b.ef - a.es) <= 1e-7"""
VIEWS["own_overrun"] = """
SELECT job_id, operation_id, nullif(actual, 0) / (nullif(done_quantity, 0) / nullif(job_quantity, 0) * nullif(expected, 0)) AS ratio FROM work_orders"""
VIEWS["cascades"] = """
SELECT e.job_id, e.operation_id, o.ratio, o.operation_id AS source_id FROM critical_edges e JOIN own_overrun o ON o.operation_id = e.pred_id AND o.ratio > 1.2
UNION SELECT e.job_id, e.operation_id, c.ratio, c.source_id FROM cascades c JOIN critical_edges e ON e.pred_id = c.operation_id"""
VIEWS["cascade_max"] = """
SELECT operation_id, max(ratio) AS ratio, min(source_id) FILTER (ratio = top) AS source_id, count(DISTINCT source_id) FILTER (ratio = top) AS sources FROM (SELECT *, max(ratio) OVER (PARTITION BY operation_id) AS top FROM cascades) GROUP BY 1"""
VIEWS["job_materials"] = """
SELECT job_id, sum(CASE WHEN available < required THEN CASE WHEN available = 0 THEN 'inf'::DOUBLE ELSE required / available END ELSE 0 END) AS shortfall, avg(vendor_ratio) AS supplier FROM components GROUP BY 1"""
VIEWS["job_progress"] = """
SELECT job_id, sum(expected * coalesce(least(greatest(done_quantity / job_quantity, 0), 1), 0)) / sum(expected) AS mo_progress FROM work_orders WHERE expected > 0 GROUP BY 1"""
VIEWS["op_pace"] = """
SELECT operation_id, avg(pace) AS pace, sum(completed) AS completed FROM wo_operators JOIN operator_pace USING (operator_id) GROUP BY 1"""
VIEWS["elements"] = """
SELECT *, CASE WHEN cascade IS NULL THEN base ELSE greatest(cascade, coalesce(base, 0) + (cascade - 1)) END AS score FROM (
 SELECT w.*, o.ratio AS time_overrun, pr.worst AS predecessor, op.pace, op.completed, coalesce(m.shortfall, 0) AS shortfall, m.supplier, g.mo_progress, c.ratio AS cascade, c.source_id, cp.critical, cp.valid, cp.float_minutes,
 (coalesce(0.50 * o.ratio, 0) + coalesce(0.35 * op.pace, 0) + 0.10 * coalesce(m.shortfall, 0) + coalesce(0.05 * m.supplier, 0)) / (CASE WHEN o.ratio IS NULL THEN 0 ELSE 0.50 END::DOUBLE + CASE WHEN op.pace IS NULL THEN 0 ELSE 0.35 END::DOUBLE + 0.10::DOUBLE + CASE WHEN m.supplier IS NULL THEN 0 ELSE 0.05 END::DOUBLE) AS base,
 (coalesce(nullif(w.actual, 0) / (nullif(w.done_quantity, 0) / nullif(w.job_quantity, 0)), w.expected * op.pace) - w.expected) / 60 AS predicted,
 coalesce(w.operation_name, w.operation_type || ' · ' || substr(w.operation_id, 1, 8)) AS label
 FROM work_orders w JOIN own_overrun o ON o.operation_id = w.operation_id LEFT JOIN (SELECT e.operation_id, max(x.ratio) AS worst FROM edges e JOIN own_overrun x ON x.operation_id = e.pred_id GROUP BY 1) pr ON pr.operation_id = w.operation_id
 LEFT JOIN op_pace op ON op.operation_id = w.operation_id LEFT JOIN job_materials m ON m.job_id = w.job_id LEFT JOIN job_progress g ON g.job_id = w.job_id
 LEFT JOIN cascade_max c ON c.operation_id = w.operation_id LEFT JOIN cpm cp ON cp.operation_id = w.operation_id)"""
