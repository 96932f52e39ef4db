"""Derived text tables over the given tables, by one SQL text for every engine.

The given documents hold few secrets; these views write lines with secrets, networks, key-value blocks and requests out of the
keys of larger tables, one line a row.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .lines import LINES, SCORED_LINES, lines_view

VIEWS: dict[str, str] = {
    "v_secret_lines": "SELECT o_orderkey AS doc_id, CONCAT('s', CAST(o_custkey % 97 AS STRING)) AS session_id, o_orderkey AS seq, CASE o_orderkey % 12 WHEN 0 THEN CONCAT('DB_PASSWORD=Vault', CAST(o_custkey AS STRING), '!Horse') WHEN 1 THEN CONCAT('key AKIA', UPPER(SUBSTR(MD5(CAST(o_custkey AS STRING)), 1, 16)), ' in use') WHEN 2 THEN CONCAT('OPENAI_API_KEY=sk-proj-', MD5(CAST(o_custkey AS STRING))) WHEN 3 THEN CONCAT('push with ghp_', MD5(CAST(o_orderkey AS STRING)), ' now') WHEN 4 THEN CONCAT('Authorization: Bearer ', MD5(CAST(o_custkey AS STRING))) WHEN 5 THEN CONCAT('DATABASE_URL=postgres://app:Pw', CAST(o_custkey AS STRING), 'x!9@db.internal:5432/app') WHEN 6 THEN CONCAT('Cookie: theme=dark; sessionid=', MD5(CAST(o_orderkey AS STRING))) WHEN 7 THEN CONCAT('token_limit=4096 region=eu-central-1 id=', CAST(o_orderkey AS STRING)) WHEN 8 THEN CONCAT('mail user', CAST(o_custkey AS STRING), '@corp-mail.io today') WHEN 9 THEN CONCAT('example: my password is Demo', CAST(o_orderkey AS STRING), '!') WHEN 10 THEN CONCAT('my db password is Forest', CAST(o_custkey AS STRING), '!x') ELSE CONCAT('password=[PWM_', CAST(o_custkey % 9 + 1 AS STRING), ']') END AS text FROM orders",
    "v_net_lines": "SELECT event_id AS doc_id, CONCAT('u', CAST(user_id AS STRING)) AS session_id, event_id AS seq, ts, CASE event_id % 5 WHEN 0 THEN CONCAT('gateway ', CAST(user_id % 223 + 1 AS STRING), '.8.', CAST(event_id % 256 AS STRING), '.10 up') WHEN 1 THEN CONCAT('route ', CAST(user_id % 223 + 1 AS STRING), '.8.0.0/16 via dns ', CAST(user_id % 223 + 1 AS STRING), '.8.4.4') WHEN 2 THEN CONCAT('host 10.0.', CAST(event_id % 256 AS STRING), '.', CAST(user_id % 256 AS STRING), ' ok') WHEN 3 THEN CONCAT('subnet ', CAST(user_id % 223 + 1 AS STRING), '.8.', CAST(event_id % 4 * 64 AS STRING), '.0/24') ELSE CONCAT('bad 999.1.1.', CAST(event_id % 300 AS STRING), ' v1.2.3') END AS text FROM events",
    "v_kv_blocks": "SELECT s_suppkey AS doc_id, CONCAT('t', CAST(s_nationkey AS STRING)) AS session_id, s_suppkey AS seq, CONCAT('Type,Value,Notes', CHR(10), 'tenantId,', SUBSTR(MD5(s_name), 1, 8), '-', SUBSTR(MD5(s_name), 9, 4), '-', SUBSTR(MD5(s_name), 13, 4), '-', SUBSTR(MD5(s_name), 17, 4), '-', SUBSTR(MD5(s_name), 21, 12), ',x', CHR(10), 'AWS account,', CAST(100000000000 + s_suppkey AS STRING), ',x', CHR(10), 'Kubernetes namespace,prod-ns-', CAST(s_nationkey AS STRING), ',x', CHR(10), CHR(10), 'plain,', CAST(s_suppkey AS STRING)) AS text FROM supplier",
    "v_requests": "SELECT page_id AS request_id, url, CONCAT('s', CAST(page_id % 97 AS STRING)) AS session_id FROM pages",
    "v_audit": "SELECT event_id, ts, CASE WHEN event_type IN ('error','signup') THEN 'blocked' ELSE 'redacted' END AS action, event_type AS finding_type, CONCAT('u', CAST(user_id AS STRING)) AS tenant FROM events",
    "v_eval": "SELECT d.doc_id, d.lang AS category, d.source AS source_type, CASE WHEN l.toxic = 1 THEN 'SECRET' WHEN l.quality = 1 THEN 'NOT_SECRET' ELSE 'UNSURE' END AS label, CASE WHEN d.text LIKE '%@%' OR d.text LIKE '%token%' THEN 'SECRET' WHEN d.n_chars > 2000 THEN 'UNSURE' ELSE 'NOT_SECRET' END AS prediction FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "v_boxes": "SELECT l_orderkey AS doc_id, l_linenumber AS box_no, (l_linenumber - 1) * 8 AS box_start, l_linenumber * 8 AS box_end, l_linenumber * 40 AS x, 10 AS y, 38 AS width, 12 AS height, CASE CAST(l_suppkey AS INT) % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence FROM lineitem",
}
# Logins of many shapes, headers and disclosures, one kind a supplier.
_H = "SUBSTR(MD5(s_name), 1, 12)"
_LOGINS = (
    "CONCAT('mysql://root', s_suppkey, ':root', s_suppkey, '@10.0.0.5/x')", f"CONCAT('clone https://bob:p@ss', {_H}, 'Z9@git.acme.org/r?a=b@c now')", "CONCAT('see https://https:https@git', s_suppkey, '.acme.org/r')",
    f"CONCAT('ftp://us%40er:pa%20', {_H}, '%3Aq1@[2001:db8::', s_suppkey, ']:21/x')", f"CONCAT('https://u', s_suppkey, ':b%zz', {_H}, '@h.io:443')", "CONCAT('postgres://postgres:postgres@db', s_suppkey, ':5432/app')",
    f"CONCAT('<https://oauth2:', {_H}, '@git.acme.org> and smtp://a:b:', {_H}, '@mail.acme.org:25')", f"CONCAT('https://[PWM_1]:[PWM_2]@', {_H}, 'Q9@host.io/x')", f"CONCAT('https://u:[PWM_2]tail', {_H}, '@host.io/x')",
    f"CONCAT('git+https://bob:', {_H}, '@git.acme.org https://bob:', {_H}, '@bad_host!/')", "CONCAT('demo https://user:password@example.com/', s_suppkey)", f"CONCAT('GET /', CHR(13), CHR(10), 'Cookie: theme=dark; sessionid=', {_H}, {_H}, '; sid=', {_H}, CHR(13), CHR(10), 'x-api-key: ', {_H})",
    f"CONCAT('my db password is ', {_H}, '!X and again the same password: ', {_H}, '!X')", f"CONCAT('note', CHR(10), 'p a s s w o r d: \"', {_H}, '!X\"')", "CONCAT('use this access token ', MD5(s_name), '; ipv6 = 2001:db8::', s_suppkey)", f"CONCAT('secret_b64=', CASE s_suppkey % 2 WHEN 0 THEN 'cGFzc3dvcmQ9SGFyYm9yNzc=' ELSE 'SGVsbG8gV29ybGQh' END, ' ', {_H})",
)
VIEWS["v_login_lines"] = "SELECT s_suppkey * 100 + k AS doc_id, CONCAT('s', CAST(s_nationkey AS STRING)) AS session_id, s_suppkey * 100 + k AS seq, CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_LOGINS)) + f" END AS text FROM supplier CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(len(_LOGINS)))}) kinds(k)"
# Assignments and connection strings, one kind a supplier.
_ASSIGNED = (
    f"CONCAT('DATABASE_URL=postgres://app:', {_H}, '@db', s_suppkey, '.corp:5432/app')", f"CONCAT('redis_uri: \"redis://:', {_H}, '@10.1.2.3:6379\" x')", f"CONCAT('MYSQL_URL=mysql://app:pw', '@db', s_suppkey, ' site_url=https://u:', {_H}, '@h.io')",
    f"CONCAT('AzureWebJobsStorage=DefaultEndpointsProtocol=https;AccountName=a', s_suppkey, ';AccountKey=', {_H}, '==;EndpointSuffix=core.windows.net')", f"CONCAT('SB_CONNECTION_STRING: \"Endpoint=sb://ns', s_suppkey, '.host/;SharedAccessKeyName=root;SharedAccessKey=', {_H}, '\"')",
    f"CONCAT('ConnString=Host=db', s_suppkey, ';Port=5432;Pwd=', {_H})", f"CONCAT('connectionString=Host=sample;Port=5432;Pwd=', {_H})", "CONCAT('connString=Host=db', s_suppkey, ';Port=5432')",
    f"CONCAT('JDBC_URL=jdbc:sqlserver://host:1433;user=name;password=Jx', {_H}, ';databaseName=prod')", f"CONCAT('Server=tcp:db', s_suppkey, ';Database=app;User Id=sa;Password=Ax', {_H}, ';Encrypt=true')", f"CONCAT('Server=tcp:db', s_suppkey, ';Encrypt=true;Password=Ax', {_H})",
    f"CONCAT('cfg ', CHR(123), '\"client_secret\": \"Cx ', {_H}, ' and more\", \"page_token\": 7', CHR(125))", f"CONCAT('x=1 token=', {_H}, 'Z,b')", f"CONCAT('the token=', {_H}, 'Z')", f"CONCAT('go ?token=', {_H}, 'Z&password=', {_H}, '!')", f"CONCAT('signing secret = ', {_H}, '; app.secret: ', CHR(39), {_H}, '!q')",
    f"CONCAT('deploy_key=sk-proj-', {_H}, ' other_key=', {_H})", f"CONCAT('mailchimp_auth=', MD5(s_name), ' smtp_passwd=', {_H}, '!')", f"CONCAT('example password=', {_H}, '!')", f"CONCAT('api_token: Bearer ', {_H}, 'zQ9x$user_id=', s_suppkey)", "CONCAT('session=abc12345 auth: [PWM_', s_suppkey, ']')",
)
VIEWS["v_assigned_lines"] = "SELECT s_suppkey * 100 + k AS doc_id, CONCAT('s', CAST(s_nationkey AS STRING)) AS session_id, s_suppkey * 100 + k AS seq, CASE k " + " ".join(f"WHEN {k} THEN {t}" for k, t in enumerate(_ASSIGNED)) + f" END AS text FROM supplier CROSS JOIN (VALUES {', '.join(f'({k})' for k in range(len(_ASSIGNED)))}) kinds(k)"
VIEWS["v_rule_lines"] = lines_view(LINES)
VIEWS["v_scored_lines"] = lines_view(SCORED_LINES)
VIEWS["v_odd_rows"] = f"SELECT CASE WHEN seq % 5 = 0 THEN NULL ELSE seq - seq % 4 END AS doc_id, CASE WHEN seq % 7 = 0 THEN NULL ELSE session_id END AS session_id, seq, text FROM ({VIEWS['v_secret_lines']})"
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived table."""
    sql = VIEWS[name]
    used = [t for t in TABLES if re.search(rf"\b(?:FROM|JOIN) {t}\b", sql)]
    for t in used:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}}", sql)
    return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in used})
