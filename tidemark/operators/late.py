"""Per-period results by event time that late records correct, up to a cut-off. SQL only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T


def _ms(df: DataFrame, name: str) -> str:
    """SQL for the ms since 1970 of a timestamp column, rounded down, whatever the session's zone."""
    zoned = isinstance(df.schema[name].dataType, T.TimestampType)
    us = f"unix_micros({name})" if zoned else f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {name})"
    return f"({us} - pmod({us}, 1000)) div 1000"


def _member(name: str) -> str:
    return f"CASE WHEN startswith(ltrim(payload), '{{{{') THEN get_json_object(payload, '$.{name}') END"


def messages(df: DataFrame) -> DataFrame:
    """topic, part, off, event_ms, received_ms of collected Kafka records, one row per row.

    An identifier column that is null is taken from the payload object (a number or digits in a string); it stays null
    where the payload has none. event_ms is null for a null time or exactly the epoch.
    """
    whole = {n: f"CASE WHEN {_member(n)} RLIKE '^-?[0-9]+$' THEN try_cast({_member(n)} AS {kind}) END" for n, kind in (("_partition", "INT"), ("_offset", "BIGINT"))}
    epoch = "timestamp'1970-01-01 00:00:00Z'" if isinstance(df.schema["event_time"].dataType, T.TimestampType) else "timestamp_ntz'1970-01-01 00:00:00'"
    return df.sparkSession.sql(
        f"""
        SELECT coalesce(_topic, {_member('_topic')}) AS topic,
               coalesce(_partition, {whole['_partition']}) AS part,
               coalesce(_offset, {whole['_offset']}) AS off,
               CASE WHEN event_time <> {epoch} THEN {_ms(df, 'event_time')} END AS event_ms,
               {_ms(df, 'received_at')} AS received_ms
        FROM {{records}}
        """,
        records=df,
    )


_ONCE = """
    WITH once AS (
      SELECT topic, part, off, min(event_ms) AS event_ms, min(received_ms) AS received_ms
      FROM {msgs}
      WHERE topic IS NOT NULL AND part IS NOT NULL AND off IS NOT NULL AND event_ms IS NOT NULL
      GROUP BY topic, part, off
    ), placed AS (
      -- Never null, and written so that it shows: null checks would keep the two uses from sharing a shuffle.
      SELECT *, coalesce((off - pmod(off, {block})) div {block}, 0L) AS arrival,
             coalesce(event_ms - pmod(event_ms, {period}), 0L) AS period_start_ms
      FROM once
    ), cells AS (
      SELECT topic, part, arrival, period_start_ms, count(*) AS added, min(event_ms) AS earliest, max(event_ms) AS latest,
             min(received_ms) AS received_ms
      FROM placed GROUP BY topic, part, arrival, period_start_ms
    ), triangle AS (
      SELECT topic, part, arrival, period_start_ms, added, earliest, latest, received_ms,
             sum(added) OVER (PARTITION BY topic, part, period_start_ms ORDER BY arrival
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total,
             max(latest) OVER (PARTITION BY topic, part ORDER BY arrival
                               RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS carry,
             max(latest) OVER (PARTITION BY topic, part ORDER BY arrival
                               RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
      FROM cells
    ), decided AS (
      SELECT *, coalesce(latest < carry - {cutoff}, false) AS all_beyond, earliest >= reached - {cutoff} AS none_beyond
      FROM triangle
    )
"""


def _checked(cutoff_ms: int, block: int, period_ms: int) -> dict[str, int]:
    if cutoff_ms < 0 or block <= 0 or period_ms <= 0:
        raise ValueError("cutoff_ms must not be negative; block and period_ms must be positive")
    return {"cutoff": cutoff_ms, "block": block, "period": period_ms}


def triangle(msgs: DataFrame, cutoff_ms: int, block: int = 65_536, period_ms: int = 60_000) -> DataFrame:
    """The cells of event period by arrival block: topic, part, arrival, period_start_ms, added, earliest, latest, total,
    carry, reached, all_beyond, none_beyond.

    An arrival is ``block`` consecutive offsets. ``total`` is the period's corrected count when that arrival is in;
    ``carry`` the greatest time of all arrivals before, ``reached`` that with the arrival itself. A cell whose latest time
    is beyond the cut-off of ``carry`` is beyond as a whole; one whose earliest is within that of ``reached`` not at all.
    """
    sql = _ONCE + "SELECT topic, part, arrival, period_start_ms, added, earliest, latest, total, carry, reached, all_beyond, none_beyond FROM decided"
    return msgs.sparkSession.sql(sql, msgs=msgs, **_checked(cutoff_ms, block, period_ms))


def judged(msgs: DataFrame, cutoff_ms: int, block: int = 65_536, period_ms: int = 60_000, only_beyond: bool = False) -> DataFrame:
    """Each message once, with ``beyond``: its time is more than ``cutoff_ms`` below the greatest time of smaller offsets.

    ``msgs`` is as from ``messages``. Rows without a whole identifier or a usable time do not count; a message that came
    more than once counts with its least time and first reception. An empty table gives no rows.

    The triangle of ``triangle`` decides whole cells; only in cells that it leaves open, single messages are held
    against the greatest time before them in their arrival and the one carried from the arrivals before. So a
    partition of any size is judged arrival by arrival. ``only_beyond`` leaves out the cells without such messages.
    """
    sql = (
        _ONCE
        + """,
        inside AS (
          SELECT *, max(event_ms) OVER (PARTITION BY topic, part, arrival ORDER BY off
                                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
          FROM placed
        ), cells_of AS (
          SELECT topic, part, arrival,
                 map_from_entries(collect_list(struct(period_start_ms, struct(carry, all_beyond, none_beyond, received_ms)))) AS cells
          FROM decided WHERE NOT none_beyond OR NOT {only}
          GROUP BY topic, part, arrival
        ), met AS (
          SELECT i.*, c.cells[i.period_start_ms] AS cell
          FROM inside i JOIN cells_of c ON i.topic = c.topic AND i.part = c.part AND i.arrival = c.arrival
        )
        SELECT topic, part, off, event_ms, received_ms,
               cell.all_beyond OR (NOT cell.none_beyond AND coalesce(greatest(seen, cell.carry) - event_ms > {cutoff}, false)) AS beyond
        FROM met
        -- The reception is always that of the cell or later; it is named so that both uses read the same columns.
        WHERE cell IS NOT NULL AND (received_ms >= cell.received_ms OR received_ms IS NULL)
        """
    )
    return msgs.sparkSession.sql(sql, msgs=msgs, only=only_beyond, **_checked(cutoff_ms, block, period_ms))


def revisions(judged_msgs: DataFrame, period_ms: int = 60_000, arrival_ms: int = 60_000) -> DataFrame:
    """Every corrected revision of the count per topic and event period, without messages beyond the cut-off.

    One row per topic, period and arrival period that brought messages: period_start_ms, arrival_start_ms, revision
    (1 for the first), added, total (so far), latest_ms (greatest event time so far). The last revision of a period is
    its final result. Needs a reception time; messages without one are left out.
    """
    return judged_msgs.sparkSession.sql(
        """
        WITH cells AS (
          SELECT topic, event_ms - pmod(event_ms, {period}) AS period_start_ms,
                 received_ms - pmod(received_ms, {arrival}) AS arrival_start_ms,
                 count(*) AS added, max(event_ms) AS latest
          FROM {judged} WHERE NOT beyond AND received_ms IS NOT NULL
          GROUP BY 1, 2, 3
        )
        SELECT topic, period_start_ms, arrival_start_ms,
               CAST(row_number() OVER w AS BIGINT) AS revision, added,
               sum(added) OVER w AS total, max(latest) OVER w AS latest_ms
        FROM cells
        WINDOW w AS (PARTITION BY topic, period_start_ms ORDER BY arrival_start_ms
                     ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        """,
        judged=judged_msgs,
        period=period_ms,
        arrival=arrival_ms,
    )
