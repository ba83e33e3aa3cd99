"""SQL that DuckDB runs on the same tables, one statement per checked query."""

from __future__ import annotations

COMPONENT = "case when user_id % 50 = 0 then 'unknown' else concat('svc-', cast(user_id % 8 as varchar)) end"
MESSAGE = """case
  when event_type = 'error' and event_id % 5 = 0 then concat('Fatal crash in handler ', cast(user_id as varchar))
  when event_type = 'error' and event_id % 5 = 1 then 'connection TIMEOUT while saving'
  when event_type = 'error' then concat('save failed  code ', props)
  when event_type = 'click' and event_id % 7 = 0 then 'warning: slow click'
  when event_type = 'view' and event_id % 11 = 0 then ''
  else concat(event_type, ' by user ', cast(user_id as varchar)) end"""


def severity(text: str) -> str:
    return f"""case
  when regexp_matches(lower({text}), '\\b(fatal|crash(ed)?|panic|exception|timeout|denied)\\b') then 3
  when regexp_matches(lower({text}), '\\b(error|fail(ed|ure)?|invalid|unable|not found)\\b') then 2
  when regexp_matches(lower({text}), '\\bwarn(ing)?\\b') then 1
  else 0 end"""


def words(text: str) -> str:
    return f"len(list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> ''))"


def time_text(column: str) -> str:
    return f"""coalesce(strftime({column}, '%Y-%m-%d %H:%M:%S')
      || case when epoch_us({column}) % 1000000 <> 0 then strftime({column}, '.%f') else '' end || '+00:00', 'NaT')"""


def json_text(column: str) -> str:
    return f"""replace(replace({column}, '\\', '\\\\'), '"', '\\"')"""


LABEL = "case severity_score when 3 then 'High' when 2 then 'Medium' when 1 then 'Low' else 'Normal' end"

LOGS = f"""logs as (
  select cast(event_id as varchar) as event_id, ts as normalized_timestamp, {COMPONENT} as component,
    {MESSAGE} as message, event_type as parsed_message_type, props as extracted_metrics, value
  from events)"""

FEATURES = f"""features as (
  select *, {LABEL} as severity from (
    select *, {severity('message')} as severity_score, length(message) as message_length,
      {words('message')} as word_count, hour(normalized_timestamp) as hour, minute(normalized_timestamp) as minute,
      extract(microsecond from normalized_timestamp) / 1e6 as second
    from logs))"""


def deviation(name: str, out: str) -> str:
    return f"round(abs(({name} - avg({name}) over ()) / stddev_pop({name}) over ()), 6) as {out}"


SCORES = f"""scores as (
  select *, {deviation('message_length', 'isolation_forest_score')}, {deviation('value', 'autoencoder_score')},
    {deviation('second', 'hdbscan_score')}
  from features)"""


def rank(name: str) -> str:
    return f"""(rank() over (order by {name}_score) + (count(*) over (partition by {name}_score) - 1) / cast(2 as double))
      / cast(count(*) over () as double) as {name}_percentile"""


def quantile(table: str, column: str, share: str) -> str:
    """Linear interpolation, spelled out."""
    return f"""(select min(v) filter (where k >= floor(p)) +
       (min(v) filter (where k >= ceil(p)) - min(v) filter (where k >= floor(p))) * (any_value(p) - floor(any_value(p)))
     from (select {column} as v, row_number() over (order by {column}) - 1 as k, {share} * (count(*) over () - 1) as p from {table}))"""


def scored(table: str = "scores", density_share: str = "cast(0.985 as double)") -> str:
    share = "cast(0.985 as double)"
    return f"""thresholds as (
  select {quantile(table, 'isolation_forest_score', share)} as t1, {quantile(table, 'autoencoder_score', share)} as t2,
    {quantile(table, 'hdbscan_score', density_share)} as t3),
scored as (
  select *, (isolation_forest_percentile + autoencoder_percentile + hdbscan_percentile) / cast(3 as double) as ensemble_score,
    anomaly_votes >= 2 as ensemble_anomaly, is_anomaly or severity_score >= 2 as is_signal
  from (
    select *, autoencoder_score as anomaly_score, autoencoder_anomaly as is_anomaly,
      isolation_forest_anomaly::int + autoencoder_anomaly::int + hdbscan_anomaly::int as anomaly_votes
    from (
      select s.*, isolation_forest_score >= t1 as isolation_forest_anomaly, autoencoder_score >= t2 as autoencoder_anomaly,
        hdbscan_score >= t3 as hdbscan_anomaly, {rank('isolation_forest')}, {rank('autoencoder')}, {rank('hdbscan')}
      from {table} s, thresholds)))"""


SCORED = ",\n".join([LOGS, FEATURES, SCORES, scored()])
SEVERITY_SIGNALS = f"""{LOGS}, {FEATURES},
signals as (select *, false as is_anomaly from features where severity_score >= 2)"""
SCORED_SIGNALS = f"{SCORED}, signals as (select * from scored where is_signal)"


def sessions(gap: float = 5) -> str:
    return f"""lagged as (
  select *, lag(normalized_timestamp) over w as previous_time, lag(component) over w as previous_component
  from signals window w as (order by normalized_timestamp nulls last, event_id)),
gaps as (
  select *, (epoch_us(normalized_timestamp) - epoch_us(previous_time)) / 6e7 as gap_minutes,
    component <> previous_component as changed
  from lagged),
numbered as (
  select *, cast(sum(opens) over (order by normalized_timestamp nulls last, event_id rows unbounded preceding) as bigint) as session
  from (select *, case when gap_minutes > {gap} or (changed and gap_minutes > 1) then 1 else 0 end as opens from gaps))"""


def incidents(gap: float = 5) -> str:
    return f"""{sessions(gap)},
placed as (
  select *, row_number() over (partition by session order by n desc, first_seen, component) as place
  from (select session, component, count(*) as n, min((normalized_timestamp, event_id)) as first_seen
        from numbered group by all)),
lists as (
  select session, string_agg(component, ', ' order by place) filter (where place <= 8) as affected_components,
    min(component) filter (where place = 1) as primary_component
  from placed group by session),
incidents as (
  select printf('INC-%05d', session) as incident_id, start_time, end_time,
    round_even((epoch_us(end_time) - epoch_us(start_time)) / 6e7, 2) as duration_minutes, event_count,
    affected_components, primary_component,
    case top when 3 then 'High' when 2 then 'Medium' else 'Low' end as severity, anomaly_count
  from (select session, min(normalized_timestamp) as start_time, max(normalized_timestamp) as end_time,
          count(*) as event_count, max(severity_score) as top, count(*) filter (where is_anomaly) as anomaly_count
        from numbered group by session) join lists using (session))"""


EVIDENCE = """evidence as (
  select * from (
    select i.incident_id, s.*, row_number() over (partition by i.incident_id order by s.normalized_timestamp, s.event_id) as place
    from scored s join incidents i on s.normalized_timestamp between i.start_time and i.end_time)
  where place <= 40)"""
INCIDENTS = f"{SCORED_SIGNALS}, {incidents()}"
WITH_EVIDENCE = f"{INCIDENTS}, {EVIDENCE}"


def top_values(column: str, name: str) -> str:
    return f"""{name}_top as (
  select incident_id, '{{' || string_agg('''' || value || ''': ' || n, ', ' order by n desc, first) || '}}' as {name}
  from (select incident_id, {column} as value, count(*) as n, min(place) as first,
          row_number() over (partition by incident_id order by count(*) desc, min(place)) as r
        from evidence group by incident_id, {column})
  where r <= 5 group by incident_id)"""


FIGURES = f"""{top_values('component', 'top_components')}, {top_values('parsed_message_type', 'top_types')},
figures as (
  select incident_id, evidence_records, anomalous_records, error_records, top_components, top_types
  from (select incident_id, count(*) as evidence_records, count(*) filter (where is_anomaly) as anomalous_records,
          count(*) filter (where severity_score >= 2) as error_records from evidence group by incident_id)
  join top_components_top using (incident_id) join top_types_top using (incident_id))"""

# The report and the prompt, as the operators give them.
SUMMARY = f"""'### Incident Summary

**' || incident_id || '** is a **' || severity || '** incident affecting
**' || primary_component || '** from **' || {time_text('start_time')} || '** to
**' || {time_text('end_time')} || '**.

- Evidence records: **' || evidence_records || '**
- Anomalous records: **' || anomalous_records || '**
- Error/failure signals: **' || error_records || '**
- Dominant components: `' || top_components || '`
- Dominant message types: `' || top_types || '`

**Assessment:** The incident is correlated from timestamp proximity and operational
error/anomaly signals. This is an evidence summary, not a definitive root-cause claim.
Review the evidence records before taking action.'"""

PROMPT = f"""'
You are an SRE/log-analysis assistant.
Analyze ONLY the evidence below.

Incident metadata:
' || '{{"incident_id":"' || incident_id || '","severity":"' || severity || '","primary_component":"' || primary_component
  || '","start_time":"' || {time_text('start_time')} || '","end_time":"' || {time_text('end_time')}
  || '","event_count":' || event_count || '}}' || '

Evidence:
' || rows || '

Return:
1. Executive summary
2. Strongest evidence
3. Probable cause hypotheses, clearly labeled as hypotheses
4. Affected components
5. Recommended investigation steps
6. Confidence and limitations

Do not invent log events, metrics, root causes, or remediation results.
'"""

EVIDENCE_JSON = f"""payload as (
  select incident_id, '[' || string_agg('{{"normalized_timestamp":"' || {time_text('normalized_timestamp')}
    || '","component":"' || component || '","parsed_message_type":"' || parsed_message_type || '","message":"'
    || {json_text('message')} || '","severity":"' || severity || '","is_anomaly":' || is_anomaly || '}}', ',' order by place) || ']' as rows
  from evidence group by incident_id)"""

LINE_TIME = """case event_id % 5
    when 0 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'
    when 1 then strftime(ts, '%Y-%m-%d %H:%M:%S') || '+05:30'
    when 2 then strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')
    when 3 then strftime(ts, '%Y-%m-%d')
    else 'no time at all' end"""

LINES = f"""source as (select *, {COMPONENT} as component, {MESSAGE} as message from events),
lines as (
  select event_id as id, props, case
    when event_id % 101 = 0 then '  '
    when event_id % 97 = 0 then '{{bad json'
    when event_id % 89 = 0 then '[1]'
    else '{{"event_id": "' || event_id || '"'
      || case when event_id % 7 = 0 then '' when event_id % 11 = 0 then ', "component": null'
              else ', "component": "' || component || '"' end
      || case when event_id % 13 = 0 then '' else ', "parsed_message_type": "' || event_type || '"' end
      || ', "normalized_timestamp": "' || {LINE_TIME} || '"'
      || case when event_id % 17 = 0 then '' else ', "message": "' || {json_text('message')} || '"' end
      || ', "extracted_metrics": ' || props
      || case when event_id % 3 = 0 then ', "host": "h' || (event_id % 10) || '"' else '' end
      || case when event_id % 4 = 0 then ', "trace_id": {{"span": ' || event_id || '}}' else '' end || '}}' end as line
  from source),
records as (
  select id, props, line, json_keys(line) as keys from lines
  where json_valid(line) and trim(line) like '{{%')"""

METRICS = """metrics as (
  select cast(event_id as varchar) as event_id, case
    when event_id % 19 = 0 then '{}'
    when event_id % 23 = 0 then null
    else '{"z": ' || event_id || ', "io": {"read": ' || user_id || '.5, "deep": {"x": ' || (event_id % 4) || '}}, "ok": '
      || case when event_id % 2 = 0 then 'true' else 'false' end || ', "mixed": '
      || case when event_id % 3 = 0 then '"text"' else '1' end || ', "name": "' || event_type || '"'
      || ', "a": 1, "b": 2, "c": 3, "d": 4, "e": 5, "f": 6}' end as m
  from events)"""

CENTROIDS = """parts as (
  select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos from embeddings),
centroids as (select label, pos, avg(v) as c from parts group by label, pos)"""

def pairs(size: int, seed: int) -> str:
    return f"""coordinates as (
  select vec_id, label, unnest(embedding)::double as v, generate_subscripts(embedding, 1) as pos
  from (select * from embeddings order by md5(concat(vec_id, ':{seed}')) limit {size})),
vectors as (select vec_id, label, list(v order by pos) as v from coordinates group by all),
pairs as (
  select a.vec_id as id, a.label as own, b.vec_id as other_id, b.label as other, list_distance(a.v, b.v) as d
  from vectors a, vectors b)"""


def rows(ctes: str, select: str) -> str:
    return f"with {ctes}\n{select}"


def evaluation_row(title: str, name: str) -> str:
    return f"""select '{title}' as model, count(*) filter (where {name}_anomaly) as anomalies,
    round_even(count(*) filter (where {name}_anomaly) / count(*)::double * 100, 2) as anomaly_rate_pct,
    round_even(count(*) filter (where {name}_anomaly and severity_score >= 2) / nullif(count(*) filter (where severity_score >= 2), 0)::double * 100, 2)
      as rule_alignment_pct,
    round_even(median({name}_score), 4) as median_score from scored"""


EVALUATION = "\nunion all ".join(
    evaluation_row(*pair)
    for pair in (
        ("Isolation Forest", "isolation_forest"),
        ("Autoencoder", "autoencoder"),
        ("HDBSCAN", "hdbscan"),
        ("Ensemble (2/3)", "ensemble"),
    )
)

PAGE = "event_id, normalized_timestamp, component, parsed_message_type, message, severity, anomaly_score, is_anomaly"
INCIDENT = "incident_id, start_time, end_time, duration_minutes, event_count, affected_components, primary_component, severity, anomaly_count"
TIME_ORDER = "order by normalized_timestamp nulls last, event_id"

ACTIVITY = "count(event_id) as logs, cast(sum(is_anomaly::int) as bigint) as anomalies"


def agreement(left: str, right: str, title: str) -> str:
    return f"select '{title}' as pair, round_even(avg(({left}_anomaly = {right}_anomaly)::int::double) * 100, 2) as agreement_pct from scored"


def top_lines(field: str) -> str:
    return f"""select value, count(*) as records from (
      select case when list_contains(keys, '{field}') then json_extract_string(line, '$.{field}') else 'MISSING' end as value
      from records)
    group by value order by records desc, value nulls first limit 10"""


def hours(test: str = "") -> str:
    return rows(
        f"""{SCORED}, counts as (
          select date_trunc('hour', normalized_timestamp) as hour_start, {ACTIVITY} from scored {test} group by 1)""",
        """select h.hour_start, coalesce(logs, 0) as logs, coalesce(anomalies, 0) as anomalies
        from (select unnest(generate_series(min(hour_start), max(hour_start), interval 1 hour)) as hour_start from counts) h
        left join counts using (hour_start) order by 1""",
    )


def numeric_leaf(name: str, path: str, place: int, kinds: str) -> str:
    return f"""select '{name}' as feature, {place} as place from metrics
    having bool_and(json_type(m, '{path}') in ({kinds})) filter (where json_type(m, '{path}') is not null)"""


NUMBER = "'UBIGINT', 'BIGINT', 'DOUBLE'"
# Leaves in the order of a record: top-level values first, then nested ones.
LEAVES = (
    ("metric_z", "$.z"),
    ("metric_ok", "$.ok"),
    ("metric_mixed", "$.mixed"),
    ("metric_name", "$.name"),
    ("metric_a", "$.a"),
    ("metric_b", "$.b"),
    ("metric_c", "$.c"),
    ("metric_d", "$.d"),
    ("metric_e", "$.e"),
    ("metric_f", "$.f"),
    ("metric_io.read", "$.io.read"),
    ("metric_io.deep.x", "$.io.deep.x"),
)
LEAF_ROWS = "\nunion all ".join(numeric_leaf(name, path, i, NUMBER) for i, (name, path) in enumerate(LEAVES))
BASE_ROWS = """select unnest(['message_length', 'word_count', 'severity_score', 'hour', 'minute', 'second']) as feature,
  unnest([-6, -5, -4, -3, -2, -1]) as place"""

CLEANED = "case when v is null or isnan(v) or isinf(v) then 0.0::double else v end"


def statements() -> dict[str, str]:
    return {
        "s1_jsonl_scan": rows(
            LINES,
            """select json_extract_string(line, '$.event_id') as event_id, json_extract_string(line, '$.component') as component,
              json_extract_string(line, '$.message') as message, json_extract_string(line, '$.parsed_message_type') as parsed_message_type,
              cast(json(props) as varchar) as extracted_metrics, json_extract_string(line, '$.host') as host,
              cast(json_extract(line, '$.trace_id') as varchar) as trace_id, null::varchar as bad_line
            from records
            union all select null, null, null, null, null, null, null, line from lines
            where trim(line) <> '' and id not in (select id from records)""",
        ),
        "s2_nonempty_check": "\nunion all ".join(
            f"select '{name}' as source, count(*) = 0 as is_empty from {name}"
            for name in ("events", "documents", "conversations", "pages", "orders")
        )
        + "\nunion all select 'no events', true",
        "s3_required_columns": rows(
            LINES,
            "\nunion all ".join(
                f"""select '{source}' as source, '{field}' as field,
                  count(*) filter (where list_contains(keys, '{field}')) as records,
                  count(*) filter (where list_contains(keys, '{field}')) = 0 as is_missing from records where {test}"""
                for source, test in (("all", "true"), ("no component", "line not like '%\"component\": %'"))
                for field in ("event_id", "normalized_timestamp", "component", "message", "parsed_message_type")
            ),
        ),
        "s4_timestamp_parse": rows(
            f"t as (select event_id, {LINE_TIME} as text, ts from events)",
            """select event_id, text, epoch_us(case event_id % 5 when 4 then null
                 when 1 then date_trunc('second', ts) - interval '5 hours 30 minutes'
                 when 3 then date_trunc('day', ts) else ts end) as micros from t""",
        ),
        "s5_null_defaults": f"""with {LOGS}
            select event_id, case when cast(event_id as int) % 3 = 0 then '' else message end as message,
              case when cast(event_id as int) % 4 = 0 then 'unknown' else component end as component,
              case when cast(event_id as int) % 5 = 0 then 'unknown' else parsed_message_type end as parsed_message_type
            from logs""",
        "s6_time_order": rows(LOGS, f"select event_id, normalized_timestamp, component from logs {TIME_ORDER}"),
        "s7_line_counts": rows(
            LINES,
            """select (select count(*) from records) as records,
              (select count(*) from lines where trim(line) <> '') - (select count(*) from records) as invalid_lines,
              (select count(distinct case when list_contains(keys, 'component')
                 then coalesce(json_extract_string(line, '$.component'), '<null>') else 'MISSING' end) from records) as components""",
        ),
        "s8_top_components": rows(LINES, top_lines("component")),
        "s8_top_message_types": rows(LINES, top_lines("parsed_message_type")),
        "s9_absent_fields": rows(
            LINES,
            """select field, count(*) as records from records,
              (select unnest(['event_id', 'normalized_timestamp', 'component', 'message', 'parsed_message_type']) as field)
            where not list_contains(keys, field) group by field""",
        ),
        "s10_export": rows(
            SCORED,
            f"select event_id, {time_text('normalized_timestamp')} as normalized_timestamp, component, message, parsed_message_type from scored",
        ),
        "s11_source_glob": rows(
            LOGS, "select parsed_message_type, count(*) as records from logs group by parsed_message_type"
        ),
        "f1_severity": rows(f"{LOGS}, {FEATURES}", "select event_id, severity, severity_score from features"),
        "f2_message_length": rows(f"{LOGS}, {FEATURES}", "select event_id, message_length from features"),
        "f2_document_length": "select doc_id, length(text) as message_length from documents",
        "f3_word_count": rows(f"{LOGS}, {FEATURES}", "select event_id, word_count from features"),
        "f4_has_metric": rows(METRICS, "select event_id, coalesce(len(json_keys(m)) > 0, false) as has_metric from metrics"),
        "f5_hour_minute": rows(f"{LOGS}, {FEATURES}", "select event_id, hour, minute from features"),
        "f6_second": rows(f"{LOGS}, {FEATURES}", "select event_id, second from features"),
        "f7_metric_columns": rows(
            METRICS,
            """select event_id, json_extract(m, '$.z')::double as metric_z, json_extract(m, '$.io.read')::double as metric_io_read,
              json_extract(m, '$.io.deep.x')::double as metric_io_deep_x, json_extract_string(m, '$.name') as metric_name,
              json_extract_string(m, '$.mixed') as metric_mixed
            from metrics""",
        ),
        "f8_feature_choice": rows(
            METRICS,
            f"""select feature, row_number() over (order by place) as position from (
              (select * from ({BASE_ROWS})) union all
              (select * from ({LEAF_ROWS}) order by place limit 8))""",
        ),
        "f9_clean_matrix": f"""with t as (select event_id, case event_id % 5 when 0 then null when 1 then 'nan'::double
              when 2 then 'infinity'::double when 3 then '-infinity'::double else value end as v from events)
            select event_id, {CLEANED} as cleaned from t""",
        "f10_standardised": rows(
            f"{LOGS}, {FEATURES}",
            "select event_id, "
            + ", ".join(
                f"round(({name} - avg({name}) over ()) / stddev_pop({name}) over (), 6) as {name}"
                for name in ("message_length", "word_count", "severity_score", "hour", "minute", "second")
            )
            + ", 0.0::double as flat from features",
        ),
        "f11_sample": rows(LOGS, "select event_id from logs order by md5(concat(event_id, ':42')) limit 5000"),
        "a1_tree_rows": """select cast(t as int) as tree, least(256, n) as root_rows, least(256, n) as leaf_rows
            from (select unnest(range(150)) as t), (select count(*) as n from events)""",
        "a2_score_bounds": "select count(*) as rows, count(*) as records, count(*) as inside from events",
        "a3_training": "select cast(8 as int) as epochs, count(*) > 0 as improved from events",
        "a4_score_bounds": "select count(*) as rows, count(*) as records, count(*) as inside from events",
        "a5_norms": """select vec_id, round(sqrt(list_sum(list_transform(embedding, lambda v: v::double * v::double))), 6) as norm
            from embeddings""",
        "a6_cluster_sizes": "select count(*) as rows, true as large_enough, true as consecutive from events",
        "a6_core_distance": rows(
            pairs(10**12, 43),
            """select id as vec_id, round(max(d), 6) as core from (
              select id, d, row_number() over (partition by id order by d) as k from pairs) where k <= 10 group by id""",
        ),
        "a7_centroids": rows(CENTROIDS, "select label, pos, round(c, 6) as mean from centroids"),
        "a8_nearest_centroid": rows(
            CENTROIDS,
            """select vec_id, round(sqrt(best.d2), 6) as distance, best.label as nearest_label from (
              select vec_id, min({'d2': d2, 'label': label}) as best from (
                select p.vec_id, c.label, sum((p.v - c.c) * (p.v - c.c)) as d2
                from parts p join centroids c on p.pos = c.pos group by p.vec_id, c.label) group by vec_id)""",
        ),
        "a9_threshold_flag": rows(
            SCORED,
            """select event_id, isolation_forest_anomaly, autoencoder_anomaly, hdbscan_anomaly from scored""",
        ),
        "a10_noise_threshold": rows(
            f"""{LOGS}, {FEATURES}, {SCORES},
            noise as (select greatest(cast(98.5 as double), 100.0::double * (1.0::double - count(*) filter (where value > 400) / count(*)::double)) as percentile from scores),
            threshold as (select {quantile('scores', 'hdbscan_score', '(select percentile from noise) / 100')} as t)""",
            """select round(percentile, 6) as percentile, round(t, 6) as threshold,
              (select count(*) from scores where hdbscan_score >= t) as flagged from noise, threshold""",
        ),
        "a11_no_cluster": """select vec_id, 1.0::double as hdbscan_score, true as hdbscan_anomaly, cast(0 as bigint) as clusters
            from embeddings""",
        "a12_percentile_rank": rows(
            SCORED,
            """select event_id, round(isolation_forest_percentile, 9) as isolation_forest_percentile,
              round(autoencoder_percentile, 9) as autoencoder_percentile, round(hdbscan_percentile, 9) as hdbscan_percentile from scored""",
        ),
        "a13_votes": rows(SCORED, "select event_id, anomaly_votes from scored"),
        "a14_consensus": rows(SCORED, "select event_id, ensemble_anomaly from scored"),
        "a15_ensemble_score": rows(SCORED, "select event_id, round(ensemble_score, 9) as ensemble_score from scored"),
        "a16_primary_signal": rows(SCORED, "select event_id, anomaly_score, is_anomaly from scored"),
        "a17_incident_signal": rows(SCORED, "select event_id, is_signal from scored"),
        "a18_evaluation": rows(SCORED, EVALUATION),
        "a19_silhouette": rows(
            f"""{pairs(5000, 42)},
            sides as (select id, own, other, sum(d) as total, count(*) as n from pairs group by all),
            ab as (select id, own, max(total / (n - 1)) filter (where own = other) as a,
                     min(total / n) filter (where own <> other) as b from sides group by id, own)""",
            "select id as vec_id, own as label, round((b - a) / greatest(a, b), 6) as silhouette from ab",
        ),
        "a20_fit_sizes": """select 'Autoencoder' as primary_model, 7 as feature_count, count(*) as training_sample,
              least(15000, count(*)) as hdbscan_sample, '2 of 3 models' as ensemble_rule from events""",
        "a21_flag_counts": "select count(*) > 0 as agree, cast(4 as int) as models from events",
        "detected_event_counts": "select count(*) > 0 as every_signal_once from events",
        "i1_signals": rows(SCORED_SIGNALS, "select event_id, component, severity_score, is_anomaly from signals"),
        "i2_time_gap": rows(
            f"{SCORED_SIGNALS}, {sessions()}", "select normalized_timestamp, gap_minutes from gaps"
        ),
        "i3_component_change": rows(
            f"{SCORED_SIGNALS}, {sessions()}", "select normalized_timestamp, coalesce(changed, true) as changed from gaps"
        ),
        "i4_sessions": rows(f"{SCORED_SIGNALS}, {sessions()}", "select event_id, session from numbered"),
        "i4_sessions_30_minutes": rows(f"{SCORED_SIGNALS}, {sessions(30)}", "select event_id, session from numbered"),
        "i5_incidents_by_severity": rows(f"{SEVERITY_SIGNALS}, {incidents()}", f"select {INCIDENT} from incidents"),
        "i5_incidents": rows(INCIDENTS, f"select {INCIDENT} from incidents"),
        "i5_incidents_30_minutes": rows(f"{SCORED_SIGNALS}, {incidents(30)}", f"select {INCIDENT} from incidents"),
        "i6_modal_component": rows(INCIDENTS, "select incident_id, primary_component from incidents"),
        "i7_component_list": rows(INCIDENTS, "select incident_id, affected_components from incidents"),
        "i8_severity_label": rows(INCIDENTS, "select incident_id, severity from incidents"),
        "i9_incident_id": rows(INCIDENTS, "select incident_id, start_time from incidents"),
        "i10_list_order": rows(INCIDENTS, f"select {INCIDENT} from incidents order by severity, start_time desc"),
        "i11_no_signal": rows(INCIDENTS, f"select {INCIDENT} from incidents where false"),
        "i12_evidence": rows(WITH_EVIDENCE, "select incident_id, place, event_id, normalized_timestamp, component, message from evidence"),
        "i12_incident_evidence": rows(
            WITH_EVIDENCE,
            """select normalized_timestamp, component, parsed_message_type, message, severity, is_anomaly
            from evidence where incident_id = 'INC-00007'""",
        ),
        "i13_evidence_figures": rows(f"{WITH_EVIDENCE}, {FIGURES}", "select * from figures"),
        "i14_summaries": rows(
            f"{WITH_EVIDENCE}, {FIGURES}", f"select incident_id, {SUMMARY} as summary from incidents join figures using (incident_id)"
        ),
        "i15_prompts": rows(
            f"{WITH_EVIDENCE}, {EVIDENCE_JSON}",
            f"""select incident_id, 'You are a precise, evidence-grounded log analyst.' as role, {PROMPT} as prompt
            from incidents join payload using (incident_id)""",
        ),
        "q1_components": rows(LOGS, "select distinct component from logs order by 1"),
        "q1_message_types": rows(LOGS, "select distinct parsed_message_type from logs order by 1"),
        "q2_component_filter": rows(SCORED, f"select {PAGE} from scored where component in ('svc-1', 'unknown')"),
        "q3_type_filter": rows(SCORED, f"select {PAGE} from scored where parsed_message_type in ('error', 'click')"),
        "q4_min_severity": rows(SCORED, f"select {PAGE} from scored where severity_score >= 2"),
        "q5_overview": rows(
            INCIDENTS,
            """select count(*) as processed_logs, count(*) filter (where is_anomaly) as anomalies, count(*) filter (where severity_score >= 2) as error_signals,
              (select count(*) from incidents) as incidents
            from scored where component in ('svc-1', 'svc-2', 'unknown') and severity_score >= 1""",
        ),
        "q6_component_activity": rows(
            SCORED, f"select component, {ACTIVITY} from scored group by component order by logs desc, component limit 15"
        ),
        "q7_hourly_activity": hours(),
        "q7_component_hours": hours("where component = 'unknown'"),
        "q8_most_affected": rows(
            SCORED, f"select component, {ACTIVITY} from scored group by component order by anomalies desc, logs desc, component limit 12"
        ),
        "q9_search": rows(SCORED, f"select {PAGE} from scored where regexp_matches(message, '(?i)USER 1[0-4]$|timeout')"),
        "q10_record_page": rows(SCORED, f"select {PAGE} from scored {TIME_ORDER} limit 200"),
        "q11_model_counts": rows(
            SCORED,
            """select count(*) filter (where isolation_forest_anomaly) as isolation_forest, count(*) filter (where autoencoder_anomaly) as autoencoder,
              count(*) filter (where hdbscan_anomaly) as hdbscan, count(*) filter (where ensemble_anomaly) as ensemble from scored""",
        ),
        "q12_plot_sample": rows(
            SCORED,
            """select normalized_timestamp, anomaly_score, severity, component, parsed_message_type, message
            from scored order by md5(concat(event_id, ':42')) limit 5000""",
        ),
        "q13_rates_by_model": rows(SCORED, f"select model, anomaly_rate_pct from ({EVALUATION}) where model <> 'Ensemble (2/3)'"),
        "q14_vote_histogram": rows(
            SCORED,
            """select v || ' / 3' as votes, count(event_id) as records from (select unnest([0, 1, 2, 3]) as v)
            left join scored on anomaly_votes = v group by v order by v""",
        ),
        "q15_agreement": rows(
            SCORED,
            "\nunion all ".join(
                [
                    agreement("isolation_forest", "autoencoder", "Isolation Forest vs Autoencoder"),
                    agreement("isolation_forest", "hdbscan", "Isolation Forest vs HDBSCAN"),
                    agreement("autoencoder", "hdbscan", "Autoencoder vs HDBSCAN"),
                ]
            ),
        ),
        "q16_consensus_anomalies": rows(
            SCORED,
            """select event_id, normalized_timestamp, component, parsed_message_type, message, anomaly_votes,
              round(ensemble_score, 9) as ensemble_score, isolation_forest_score, autoencoder_score, hdbscan_score, severity
            from scored where ensemble_anomaly order by scored.ensemble_score desc, normalized_timestamp, event_id limit 500""",
        ),
        "q17_incident_lookup": rows(
            INCIDENTS,
            "select incident_id, severity, primary_component, start_time, end_time, event_count from incidents where incident_id = 'INC-00007'",
        ),
        "q18_timeline": rows(
            INCIDENTS, "select start_time, end_time, incident_id, severity, primary_component, event_count, anomaly_count from incidents"
        ),
        "q19_summary": rows(
            INCIDENTS,
            """select count(*) as total_logs, count(*) filter (where is_anomaly) as anomalies, count(*) filter (where is_signal) as signals,
              count(distinct component) as components, (select count(*) from incidents) as incidents from scored""",
        ),
        "q20_incident_listing": rows(
            INCIDENTS,
            f"select * replace ({time_text('start_time')} as start_time, {time_text('end_time')} as end_time) from incidents",
        ),
        "q21_log_page": rows(
            SCORED, f"select * replace ({time_text('normalized_timestamp')} as normalized_timestamp) from (select {PAGE} from scored {TIME_ORDER} limit 1000)"
        ),
    }
