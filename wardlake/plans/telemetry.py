"""Telemetry derived from the events table: the same columns in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_RECIPE = """
SELECT event_id, ts_us, k, value, user_id,
       concat('tenant-', CAST(user_id % 3 AS STRING)) AS tenant_id,
       concat('agent-', CAST(user_id AS STRING)) AS agent_id,
       CASE event_type WHEN 'signup' THEN 'exec' WHEN 'click' THEN 'connect' WHEN 'view' THEN 'dns_query'
            WHEN 'purchase' THEN 'file_open' ELSE 'auth' END AS type,
       100 + k % 4 AS pid, 1 + k % 3 AS ppid,
       CASE WHEN k % 10 = 0 THEN NULL ELSE k % 2 END AS process_generation,
       CASE k % 5 WHEN 0 THEN 'curl' WHEN 1 THEN 'bash' WHEN 2 THEN 'nginx' WHEN 3 THEN 'cmd.exe' ELSE 'sshd' END AS comm,
       CASE k % 4 WHEN 0 THEN '/usr/bin/curl' WHEN 1 THEN {r}'C:\\Windows\\System32\\cmd.exe' WHEN 2 THEN '/tmp/payload'
            ELSE {r}'c:\\windows\\system32\\CMD.exe' END AS image_path,
       CASE k % 3 WHEN 0 THEN 'winword.exe' WHEN 1 THEN 'nginx' ELSE NULL END AS parent_comm,
       concat(CASE WHEN k % 2 = 0 THEN '10.0.0.' ELSE '203.0.113.' END, CAST(k % 16 AS STRING)) AS daddr,
       CASE WHEN k % 7 = 0 THEN 443 ELSE 4000 + k % 5 END AS dport,
       concat('L', CAST(k AS STRING), CASE WHEN k % 2 = 0 THEN '.Example.COM.' ELSE '.example.com' END) AS query,
       k % 128 AS flags,
       CASE WHEN k % 3 = 0 THEN 'success' ELSE 'failure' END AS outcome,
       concat('user', CAST(k % 6 AS STRING)) AS target_user,
       CASE k % 8 WHEN 0 THEN 'echo aGk= | base64 -d' WHEN 1 THEN 'powershell -enc aGk=' WHEN 2 THEN 'vssadmin delete shadows'
            WHEN 3 THEN 'wevtutil cl Security' WHEN 4 THEN 'journalctl --vacuum-time=1s' WHEN 5 THEN 'ls -l /tmp'
            WHEN 6 THEN 'cat /etc/passwd; id' ELSE 'curl http://203.0.113.9/x' END AS cmdline,
       CASE k % 6 WHEN 0 THEN '/home/a/.bashrc' WHEN 1 THEN '/etc/cron.d/x' WHEN 2 THEN '/proc/12/root/etc/shadow'
            WHEN 3 THEN '/var/log/auth.log' WHEN 4 THEN '/srv/www/shell.php' ELSE '/var/lib/mysql/ibdata1' END AS path,
       CASE k % 6 WHEN 0 THEN 'T1059' WHEN 1 THEN 'T1059.001' WHEN 2 THEN 'T1059.004' WHEN 3 THEN 'T1071' WHEN 4 THEN 'T1486' ELSE 'T1110' END AS technique,
       CASE k % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' ELSE 'critical' END AS severity,
       CASE user_id % 4 WHEN 0 THEN 'canary' WHEN 1 THEN 'early' WHEN 2 THEN 'broad' ELSE 'prod' END AS ring
FROM (SELECT *, {us} AS ts_us, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k FROM {events})
"""
DAY = 86_400_000_000
#: A CTE `ev` for DuckDB.
EV = "ev AS (" + _RECIPE.format(r="", us="epoch_us(ts)", events="events").replace("\\\\", "\\") + ")"


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return spark.sql(_RECIPE.format(r="r", us="unix_micros(CAST(ts AS TIMESTAMP))", events="{events}").replace("\\\\", "\\"), events=events)


def of_type(ev: DataFrame, *types: str) -> DataFrame:
    return ev.where(ev["type"].isin(*types))
