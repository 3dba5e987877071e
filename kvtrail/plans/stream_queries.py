"""Queries that run streams over all given events, exports, encryption and the log's files."""

from __future__ import annotations

from pyspark.sql import functions as F

from kvtrail.functions import kv
from kvtrail.operators import crypto
from kvtrail.plans.catalog import query
from kvtrail.plans.views import LINES_OF_H, H, history, history_from_events
from kvtrail.sources import io
from kvtrail.sources.scratch import shared_folder
from kvtrail.streaming import ordered, running, streams


def _WS():
    return F.concat(F.lit("ws_"), (F.col("user_id") % 10).cast("string"))



#: Rows of the given log come in any order of files, so its streams wait for longer than it is.
LATE = "400 days"


@query("stream_windowed_activity", "with b as (select 'ws_' || (user_id % 10) as workspace, date_trunc('hour', ts)::timestamp as start from events) select workspace, start, count(*) as changes from b group by all")
def stream_windowed_activity(s, d):
    events = streams.event_stream(s, d).select("timestamp", _WS().alias("workspace"))
    return running.close(events, shared_folder(s, "activity"), lambda x: streams.windowed_activity(x, late=LATE)).rows


@query("stream_sliding_activity", """with b as (select 'ws_' || (user_id % 10) as workspace, time_bucket(interval 15 minute, ts)::timestamp as last, unnest([0, 15, 30, 45]) as back from events)
select workspace, last - to_minutes(back) as start, count(*) as changes from b group by all""")
def stream_sliding_activity(s, d):
    """Windows of an hour that begin every quarter of an hour."""
    events = streams.event_stream(s, d).select("timestamp", _WS().alias("workspace"))
    return running.close(events, shared_folder(s, "sliding"), lambda x: streams.windowed_activity(x, late=LATE, slide="15 minutes")).rows


@query("stream_edit_sessions", """with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events),
n as (select user_id, ts, sum(new) over (partition by user_id order by ts) as k from g) select user_id, min(ts) as start, max(ts) + interval 30 minute as "end", count(*) as edits from n group by user_id, k""")
def stream_edit_sessions(s, d):
    events = streams.event_stream(s, d).select("timestamp", "user_id")
    return running.close(events, shared_folder(s, "sessions"), lambda x: streams.edit_sessions(x, late=LATE)).rows


@query("stream_record_on_save", "select event_id::varchar as id, 'modify' as action, strftime(ts, '%Y-%m') as month from events")
def stream_record_on_save(s, d):
    saves = history_from_events(streams.event_stream(s, d).drop("timestamp"))
    return running.drain(streams.record_saves(saves), shared_folder(s, "saves")).rows.select("id", "action", "month")


@query("stream_change_data", """with b as (select event_type || (user_id % 7) as key, case when event_id % 5 > 0 then (event_id % 3)::varchar end as value, ts, event_id from events),
l as (select *, lag(value) over w as old, row_number() over w as n from b window w as (partition by key order by ts, event_id::varchar))
select key, old as old_value, value as new_value, case when value is null then 'deleted' else 'modified' end as type, ts as timestamp from l where old is not null and (value is null or value <> old)""")
def stream_change_data(s, d):
    e = streams.event_stream(s, d)
    key = F.concat("event_type", (F.col("user_id") % 7).cast("string"))
    values = e.select(key.alias("key"), F.col("event_id").cast("string").alias("id"), F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 3).cast("string")).alias("value"), "timestamp")
    return running.close(values, shared_folder(s, "changes"), lambda x: ordered.change_data(x, LATE)).rows


@query("stream_incremental_rescan", f"with {H}, c as (select left(sha256(fileContent), 16) as content_hash, epoch_us(timestamp) // 300000000 as slot, timestamp, id from h), r as (select *, row_number() over (partition by content_hash, slot order by timestamp, id) as n from c) select id, content_hash from r where n = 1")
def stream_incremental_rescan(s, d):
    saves = history_from_events(streams.event_stream(s, d).drop("timestamp"))
    return streams.fresh_content(saves, shared_folder(s, "rescan")).select("id", "content_hash")


@query("stream_branch_changes", """with b as (select 'ws_' || (user_id % 10) as workspace, event_type as branch, ts from events), s as (select *, lead(ts) over (partition by workspace order by ts, branch) - ts as stay from b),
k as (select * from s where stay is null or stay >= interval 500 millisecond), l as (select *, lag(branch) over (partition by workspace order by ts, branch) as before from k) select workspace, branch, ts as timestamp from l where before is null or before <> branch""")
def stream_branch_changes(s, d):
    """The last branch of each workspace as well: it stays until the stream is closed."""
    e = streams.event_stream(s, d).select(_WS().alias("workspace"), F.col("event_type").alias("branch"), "timestamp")
    return running.close(e, shared_folder(s, "branches"), lambda x: ordered.settled_branches(x, LATE)).rows


@query("stream_feedback_batches", "select event_id::varchar as id, true as sent from events")
def stream_feedback_batches(s, d):
    e = streams.event_stream(s, d).select(F.col("event_id").cast("string").alias("id"), F.lit(False).alias("sent"))
    path = shared_folder(s, "feedback")
    streams.feedback_batches(e, f"{path}/rows").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    return s.read.option("basePath", f"{path}/rows").parquet(f"{path}/rows/epoch=*").select("id", "sent")


def _KEY():
    return F.lit("0123456789abcdef0123456789abcdef").cast("binary")


def _OTHER():
    return F.lit("fedcba9876543210fedcba9876543210").cast("binary")


_P = f"with {LINES_OF_H}, p as (select id, trim(raw[:strpos(raw, '=') - 1]) as key, raw[strpos(raw, '=') + 1:] as value, line from hl where raw not like '#%' and strpos(raw, '=') > 1), m as (select id, key, arg_max(value, line) as value from p group by all)"


@query("encrypt_round_trip", _P + " select id, key, true as sealed, value as opened, null::varchar as wrong_key from m")
def encrypt_round_trip(s, d):
    sealed = kv.sync_pairs(history(s, d), ["id"]).withColumn("envelope", crypto.encrypt_value(F.col("value"), _KEY()))
    return sealed.select("id", "key", kv.is_encrypted(F.col("envelope")).alias("sealed"), crypto.decrypt_value(F.col("envelope"), _KEY()).alias("opened"), crypto.decrypt_value(F.col("envelope"), _OTHER()).alias("wrong_key"))


@query("rotate_keys", _P + " select id, key, value as opened from m")
def rotate_keys(s, d):
    sealed = kv.sync_pairs(history(s, d), ["id"]).withColumn("envelope", crypto.encrypt_value(F.col("value"), _KEY()))
    return sealed.select("id", "key", crypto.decrypt_value(crypto.rotate(F.col("envelope"), _KEY(), _OTHER()), _OTHER()).alias("opened"))


_ENTRY = """to_json(key) || ':{"value":' || to_json(case when not encrypted and regexp_matches(lower(key), 'key|secret|password|token|auth') then '*** MASKED SECRET ***' else value end) || ',"encrypted":' || encrypted || case when comment is null then '' else ',"comment":' || to_json(comment) end || '}'"""
_EXPORTED = f"with {LINES_OF_H}, a as (select id, line, trim(raw, ' ' || chr(9) || chr(13)) as text from hl), p as (select id, line, trim(text[:strpos(text, '=') - 1]) as key, text[strpos(text, '=') + 1:] as rest from a where text <> '' and text not like '#%' and strpos(text, '=') > 1), l as (select id, key, arg_max(rest, line) as rest from p group by 1, 2), x as (select id, key, trim(rest) as value, (trim(rest) like 'ENC[%' and trim(rest) like '%]') as encrypted, case when rest like '%#%' then trim(rest[strpos(rest, '#') + 1:]) end as comment from l)"


@query("export_json", f"""{_EXPORTED} select id, '{{"variables":{{' || string_agg({_ENTRY}, ',' order by key) || '}}}}' as document from x group by id""")
def export_json(s, d):
    return io.export_json(history(s, d), ["id"])


@query("export_encrypted_json")
def export_encrypted_json(s, d):
    return io.export_json(history(s, d), ["id"]).select("id", crypto.encrypt_value(F.col("document"), _KEY()).alias("envelope"))


@query("history_append", "select event_id::varchar as id, strftime(timestamp '2024-02-03 00:00:00', '%Y-%m') as month, 'auto' as source from events")
def history_append(s, d):
    out = io.append_history(history(s, d), f"{shared_folder(s, 'log')}", F.lit("2024-02-03 00:00:00").cast("timestamp"))
    return out.select("id", F.date_format("timestamp", "yyyy-MM").alias("month"), "source")


@query("history_export", "select event_id::varchar as id from events")
def history_export(s, d):
    path = shared_folder(s, "export")
    io.export_history(history(s, d), path)
    return s.read.schema("id string, workspace string, month string").json(path).select("id")


@query("backup_restore", "select event_id::varchar as id from events")
def backup_restore(s, d):
    path = shared_folder(s, "backup")
    files = history(s, d).select("id", "fileContent")
    io.backup(files, path, "b1")
    io.backup(files.where("id = '1'"), path, "b2")
    return io.restore_backup(s, path, "b1").select("id")


@query("feedback_sink", f"with {H} select id, timestamp, action from h order by timestamp desc, id desc limit 500")
def feedback_sink(s, d):
    return io.feedback_sink(history(s, d).select("id", "timestamp", "action"), shared_folder(s, "feedback-sink"))


@query("storage_size")
def storage_size(s, d):
    return io.storage_size(s, f"{d}/events.parquet")
