import datetime as dt

from pyspark.sql import types as T

from basketlens import schemas as S


def ts(s):
    return dt.datetime.fromisoformat(s) if s else None


def frame(spark, schema, rows):
    return spark.createDataFrame(rows, schema)


def orders_df(spark, rows):
    """rows: (id, email, completed_at, item_total, user_id, adjustment) with defaults for the rest."""
    full = [(i, e, str(i), "complete", 0, ts(c), u, tot, adj, False) for i, e, c, tot, u, adj in rows]
    return frame(spark, S.ORDERS, full)


def line_items_df(spark, rows):
    """rows: (order_id, variant_id, price, quantity, created_at)."""
    return frame(spark, S.LINE_ITEMS, [(o, v, p, q, p * 0.5, ts(c), False) for o, v, p, q, c in rows])


def variants_df(spark, rows):
    return frame(spark, S.VARIANTS, [(i, pid, sku, False) for i, pid, sku in rows])


def products_df(spark, rows):
    return frame(spark, S.PRODUCTS, [(i, n, False) for i, n in rows])


def events_df(spark, rows):
    """rows: (distinct_id, email, name, time, os, properties)."""
    return frame(spark, S.EVENTS, [(d, e, n, ts(t), o, p) for d, e, n, t, o, p in rows])


def strings(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


def executed_nodes(df):
    """(name, metrics) of every node of the executed plan, after running it."""
    df.write.format("noop").mode("overwrite").save()
    df = df.select("*")
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    out, todo = [], [plan]
    while todo:
        node = todo.pop()
        kind = node.getClass().getSimpleName()
        metrics, it = {}, node.metrics().iterator()
        while it.hasNext():
            kv = it.next()
            metrics[kv._1()] = kv._2().value()
        out.append((kind, metrics))
        if kind == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return out


def shuffled_records(df):
    return sum(m.get("shuffleRecordsWritten", 0) for _, m in executed_nodes(df))
