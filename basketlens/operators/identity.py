"""Identity stitching between web visitors (``distinct_id``) and customer
e-mail addresses.

J1: an event carrying an order number links its visitor to that order's
e-mail. J4/P16: an event's own e-mail wins, else the linked one. The map can
be many-to-many (N13): joining it fans events out, as the analysed SQL does.
Null keys are kept out of every join so no reducer receives a null-key pile,
and heavy visitors are salted (``basketlens.operators.skew``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.functions import expr as X
from basketlens.operators.skew import heavy_keys, left_join
from basketlens.session import cut_lineage


def order_links(events: DataFrame) -> DataFrame:
    """(order_number, distinct_id) for events that carry an order number. Text
    that neither names the key nor escapes anything is not parsed."""
    p = F.col("properties")
    named = events.where(p.contains("order_number") | p.contains("\\"))
    return (named.select(X.json_str("properties", "order_number").alias("order_number"), "distinct_id")
                  .where(F.col("order_number").isNotNull()).distinct())


def email_to_distinct(orders: DataFrame, events: DataFrame) -> DataFrame:
    """J1 + A1: distinct (lower(email), distinct_id) over raw orders linked by
    order number; orders without e-mail are dropped."""
    o = (orders.where(F.col("email").isNotNull())
               .select(F.col("number").alias("order_number"), F.lower("email").alias("email")))
    return (order_links(events).join(o, "order_number")
            .select("email", "distinct_id").distinct())


def resolve_email(events: DataFrame, id_map: DataFrame) -> DataFrame:
    """J4 + P16: left join the identity map, ``coalesce(lower(event email), mapped)``.

    Keeps the fan-out of a visitor with several mapped e-mails. Events without
    a visitor stay out of the join; heavy visitors are salted."""
    m = id_map.select("distinct_id", F.col("email").alias("_mapped_email"))
    joined = left_join(events, m, "distinct_id", heavy_keys(events, "distinct_id"))
    return (joined.withColumn("email", F.coalesce(F.lower(F.col("email")), F.col("_mapped_email")))
                  .drop("_mapped_email"))


def resolve_email_of(events: DataFrame, id_map: DataFrame, chosen: DataFrame) -> DataFrame:
    """``resolve_email`` restricted to the e-mails of ``chosen`` (P15), which
    cuts the click-stream before the identity join instead of after it:

      * an event with its own e-mail is wanted if that e-mail is (semi join);
        it then meets the identity map only for the fan-out (N13);
      * an event without one is wanted if its visitor maps to a chosen e-mail,
        so it joins the map of those e-mails alone.

    The list, the map and the map of the list are written first: their sizes
    are then known when the joins with the click-stream are planned, so it is
    shuffled only if the list itself is beyond the broadcast threshold."""
    chosen = cut_lineage(chosen.select("email").where(F.col("email").isNotNull()).distinct())
    id_map = cut_lineage(id_map.select("distinct_id", "email"))
    own = (events.where(F.col("email").isNotNull()).withColumn("email", F.lower("email"))
                 .join(chosen, "email", "left_semi"))
    # One row per mapped e-mail; a visitor without any (or no visitor) keeps one.
    own = left_join(own, id_map.select("distinct_id"), "distinct_id", [])
    mapped = cut_lineage(id_map.where(F.col("distinct_id").isNotNull()).join(chosen, "email", "left_semi"))
    guests = events.where(F.col("email").isNull() & F.col("distinct_id").isNotNull()).drop("email").join(mapped, "distinct_id")
    return own.unionByName(guests)


def visitor_emails(order_rollup: DataFrame, events: DataFrame) -> DataFrame:
    """The union of (order e-mail, visitor) through order numbers and
    (event e-mail, visitor) from the events themselves, de-duplicated early.

    ``order_rollup`` has (order_number, email) of valid orders. Pairs with a
    null e-mail or visitor can never join later, so they are dropped here."""
    linked = (order_links(events)
              .join(order_rollup.where(F.col("email").isNotNull()).select("order_number", "email"),
                    "order_number")
              .select(F.lower("email").alias("email"), "distinct_id"))
    own = events.select(F.lower("email").alias("email"), "distinct_id")
    return (linked.unionByName(own)
                  .where(F.col("email").isNotNull() & F.col("distinct_id").isNotNull())
                  .distinct())


def ambiguous_visitors(id_map: DataFrame) -> DataFrame:
    """Visitors whose identity maps to more than one e-mail (their events
    fan out when the map is joined), with the number of e-mails."""
    return (id_map.groupBy("distinct_id").agg(F.count(F.lit(1)).alias("emails"))
                  .where(F.col("emails") > 1))
