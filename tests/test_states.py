"""State machines and pairings against plain Python that steps through the events one by one: ties, unknown generations, either order of arrival, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from wardlake.operators import behaviour, cases, pairing
from wardlake.operators import primitives as P

EVENT = (
    "event_id long, tenant_id string, agent_id string, ts_us long, type string, pid long, ppid long, process_generation long, parent_process_generation long, "
    "comm string, image_path string, parent_comm string, cmdline string, path string, flags long, daddr string, dport int, fd int, arrived long"
)
NAMES = [c.split()[0] for c in EVENT.split(", ")]


def table(spark, rows, parts=3):
    return spark.createDataFrame([tuple(r.get(n) for n in NAMES) for r in rows], EVENT).repartition(parts)


def base(i, rng, **more):
    return {"event_id": i, "tenant_id": "t", "agent_id": rng.choice("ab"), "pid": rng.choice([7, 8]), "ts_us": rng.randrange(120), "process_generation": rng.choice([None, 1, 2])} | more


def same(a, b):
    return a is None or b is None or a == b


@pytest.fixture(params=[3, 10_000])
def batches(spark, request):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", request.param)
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_anchors_over_batches(spark, batches):
    rng = random.Random(1)
    rows = [base(i, rng, comm=rng.choice(["x", None])) for i in range(300)]
    for strict in (True, False):
        got = P.anchored_window(table(spark, rows), ["agent_id", "comm"], "ts_us", 9, "event_id", strict=strict).collect()
        want, anchor = {}, {}
        for r in sorted(rows, key=lambda r: (r["ts_us"], r["event_id"])):
            k = r["agent_id"], r["comm"]
            opens = k not in anchor or (r["ts_us"] - anchor[k] > 9 if strict else r["ts_us"] - anchor[k] >= 9)
            anchor[k] = r["ts_us"] if opens else anchor[k]
            want[r["event_id"]] = (anchor[k], opens)
        assert {r["event_id"]: (r["anchor"], r["anchor_opens"]) for r in got} == want
    assert P.anchored_window(table(spark, rows).where("false"), ["agent_id"], "ts_us", 9, "event_id").count() == 0


def behaved(i, rng):
    address = rng.choice(["203.0.113.9", "10.1.1.1", "172.31.0.1", "172.32.0.1", "224.0.0.1", "203.0.113.255", "127.0.0.1", "0.0.0.0", "::", "::1", "fe80::2", "fd00::1", "ff02::1", "2001:db8::1", None])
    path = rng.choice(["/usr/bin/x", "C:\\Users\\a\\AppData\\x", "/home/a/Downloads/x", "C:\\a\\Temp\\x", None, ""])
    kind = rng.choice(["exec", "connect", "file_open", "dns_query", "auth"])
    return base(i, rng, type=kind, daddr=address, dport=rng.choice([1, 2, 3, None]), flags=rng.choice([0, 1, 2, 64]), image_path=path, comm=rng.choice(["x", "svchost.exe", "wget"]), ppid=rng.choice([0, 5, 6]), parent_process_generation=rng.choice([None, 1, 2]))


#: Fixed by hand: whether an address of the fixture is outside.
OUTSIDE = {"203.0.113.9", "172.32.0.1", "224.0.0.1", "203.0.113.255", "2001:db8::1"}


def vector_of(seen):
    first = lambda test: next((e for e in seen if test(e)), None)
    x, c, w = first(lambda e: e["type"] == "exec"), first(lambda e: e["type"] == "connect"), first(lambda e: e["type"] == "file_open" and e["flags"])
    delay = lambda e: max(0, e["ts_us"] - x["ts_us"]) / 1000 if x and e else 0.0
    connects = [e for e in seen if e["type"] == "connect"]
    odd = bool(x) and any(p in (x["image_path"] or "").lower() for p in ("appdata", "\\temp\\", "downloads", "desktop", "\\public\\"))
    return (float(bool(x)), float(bool(c)), float(bool(w)), delay(c), delay(w), float(odd), float(len(connects)), float(len({e["dport"] for e in connects})), float(any(e["daddr"] in OUTSIDE for e in connects)))


def test_vectors_of_each_event(spark, batches):
    rng = random.Random(2)
    rows = [behaved(i, rng) for i in range(400)]
    heard = sorted((r for r in rows if r["type"] != "auth"), key=lambda r: (r["ts_us"], r["event_id"]))
    want = {}
    for n, x in enumerate(heard):
        seen = [y for y in heard[: n + 1] if (y["agent_id"], y["pid"]) == (x["agent_id"], x["pid"]) and y["ts_us"] >= x["ts_us"] - 20 and same(y["process_generation"], x["process_generation"])]
        want[x["event_id"]] = vector_of(seen)
    got = behaviour.vectors(table(spark, rows), 20, ["event_id"])
    assert got.columns == ["event_id", *behaviour.FEATURES]
    assert {r[0]: tuple(r[1:]) for r in got.collect()} == want
    assert behaviour.beliefs(table(spark, rows).where("false")).count() == 0


def test_belief_crosses_once_decays_and_starts_anew(spark):
    second = 1_000_000
    made = lambda i, s, **more: {"event_id": i, "tenant_id": "t", "agent_id": "a", "pid": 9, "ts_us": s * second, "type": "connect", "ppid": 5, "comm": "x", "daddr": "203.0.113.9", "dport": 4444, "parent_process_generation": 1, "image_path": "/home/a/Downloads/x", "parent_comm": "sh"} | more
    rows = [made(0, 0, type="exec")] + [made(i, i) for i in range(1, 8)] + [made(20, 4000), made(21, 4001), made(30, 4100, type="exec", parent_process_generation=2)]
    got = {r["event_id"]: r for r in behaviour.beliefs(table(spark, rows)).collect()}
    assert sum(r["raised"] for r in got.values() if r["ts_us"] < 100 * second) == 1
    assert got[20]["belief"] < 0 < got[7]["belief"]  # decayed to the prior in an hour
    assert got[30]["belief"] == pytest.approx(-4.6 + got[30]["evidence"])  # another parent
    assert got[0]["evidence"] == pytest.approx(-0.93 - 0.09 + 3.60 - 0.96 + 0.02 - 0.44)
    ratios = behaviour.ratios_of(spark.createDataFrame([("has_exec", "1", 0.25), ("connect_count", "5-14", 7.0)], "feature string, bin string, llr double"))
    own = {r["event_id"]: r["evidence"] for r in behaviour.beliefs(table(spark, rows), ratios=ratios).collect()}
    assert (own[0], own[4], own[5]) == (0.25, 0.25, 7.25)


def test_a_models_word_counts_from_the_next_event_on(spark):
    rows = [{"event_id": i, "tenant_id": "t", "agent_id": "a", "pid": 9, "ts_us": i, "type": "dns_query", "ppid": 5, "comm": "x", "flags": 0} for i in range(3)]
    plain = {r["event_id"]: r["belief"] for r in behaviour.beliefs(table(spark, rows)).collect()}
    told = {r["event_id"]: r["belief"] for r in behaviour.beliefs(table(spark, rows).withColumn("llr", F.when(F.col("event_id") == 0, 3.0)), model="llr").collect()}
    assert told[0] == plain[0] and told[1] - plain[1] == pytest.approx(3, abs=1e-6)


def test_verdicts(spark, batches):
    rng = random.Random(3)
    keys = "event_id long, host string, ts_us long, technique string, severity string, score double, source string, parent_process_generation long"
    rows = [(i, rng.choice("ab"), rng.randrange(90), rng.choice(["T1", "T2", "T3"]), rng.choice(["low", "medium", "high", "critical"]), rng.choice([None, 0.1, 0.5, 0.9]), rng.choice(["rule", "sigma", None]), rng.choice([None, 1, 1, 2])) for i in range(250)]
    want, states = {}, {}
    for i, host, ts, technique, severity, score, source, stamp in sorted(rows, key=lambda r: (r[2], r[0])):
        s = states.get(host)
        if s is None or not same(s["stamp"], stamp):
            s = states[host] = {"stamp": stamp, "rank": 0, "score": None, "opened": {}, "sources": [], "evidence": []}
        s["stamp"] = stamp if s["stamp"] is None else s["stamp"]
        again = technique in s["opened"] and ts - s["opened"][technique] <= 8
        if not again:
            s["opened"][technique] = ts
        rank = ["low", "medium", "high", "critical"].index(severity)
        raised = rank > s["rank"] or score is not None and (s["score"] is None or score > s["score"])
        s["rank"] = max(s["rank"], rank)
        s["score"] = max((x for x in (s["score"], score) if x is not None), default=None)
        if source is not None and source not in s["sources"]:
            s["sources"].append(source)
        s["evidence"] = [*s["evidence"], i][-16:]
        if not again or raised:
            want[i] = (s["rank"], s["score"], list(s["opened"]), list(s["sources"]), list(s["evidence"]))
    got = cases.fuse(spark.createDataFrame(rows, keys).repartition(3), ["host"], 8).collect()
    assert {r["event_id"]: (r["max_rank"], r["max_score"], r["techniques"], r["sources"], r["evidence"]) for r in got} == want
    assert 0 < len(want) < len(rows)


def test_what_a_name_adds():
    cases_ = {("/d/f", "/d/f.locked"): ".locked", ("/d/f", "/e/f.locked"): ".locked", ("/d/f", "/d/g.locked"): None, ("/d/f", "/d/f"): None, ("/d/f", "/d/f.1"): None, ("C:\\d\\f", "C:/d/f.x"): ".x"}
    cases_ |= {("/m/new/f", "/m/cur/f:2,Sa"): None, ("/m/new/f", "/n/cur/f:2,Sa"): ":2,Sa", ("/m/new/f", "/m/cur/f:2,aS"): ":2,aS", ("/d/", "/d/f.x"): "f.x", ("/d/", "/e/f.x"): None}
    for (old, new), suffix in cases_.items():
        assert pairing.replaces(new, old) == suffix, (old, new)


def test_new_files_and_unlinks_in_either_order(spark, batches):
    rng = random.Random(4)
    rows = []
    for i in range(500):
        gone, n = rng.random() < 0.5, rng.randrange(4)
        path = rng.choice([f"/d/f{n}", f"/e/f{n}"]) + ("" if gone else rng.choice([".locked", ".gz", ".1", ""]))
        rows.append(base(i, rng, type="file_delete" if gone else "file_open", path=path, flags=rng.choice([66, 66, 2, 64]), comm=rng.choice(["x", "gzip", "logrotate"]), arrived=rng.randrange(1000)))
    rows += [base(1000 + i, rng, type="exec", arrived=rng.randrange(1000), image_path=rng.choice(["/usr/bin/gzip", "/usr/sbin/logrotate", "/tmp/gzip", ""])) for i in range(60)]
    want, states = {}, {}
    for r in sorted(rows, key=lambda r: (r["arrived"], r["event_id"])):
        s = states.setdefault((r["agent_id"], r["pid"]), {"creates": [], "gone": [], "times": [], "told": None, "ran": None})
        if r["type"] == "exec":
            s["ran"] = r
            continue
        if r["type"] == "file_open" and r["flags"] not in (66, 64):
            continue
        gone = r["type"] == "file_delete"
        mine, theirs = (s["gone"], s["creates"]) if gone else (s["creates"], s["gone"])
        order = reversed(theirs) if gone else iter(theirs)
        fit = lambda o: (lambda d, c: 0 <= d["ts_us"] - c["ts_us"] <= 40 and pairing.replaces(c["path"], d["path"]))(*((r, o) if gone else (o, r)))  # noqa: B023, E731
        partner = next((o for o in order if fit(o)), None)
        if partner is None:
            mine.append(r)
            continue
        theirs.remove(partner)
        when = (r if gone else partner)["ts_us"]
        own = s["ran"] is not None and same(s["ran"]["process_generation"], r["process_generation"]) and s["ran"]["image_path"] in (f"/usr/bin/{r['comm']}", f"/usr/sbin/{r['comm']}")
        suffix = fit(partner) and pairing.replaces(*((partner["path"], r["path"]) if gone else (r["path"], partner["path"])))
        if own and (r["comm"] == "gzip" or suffix == ".gz"):
            want[r["event_id"]] = (partner["path"], 0, False)
            continue
        while s["times"] and when - s["times"][0] > 30:
            s["times"].pop(0)
        s["times"].append(when)
        alert = len(s["times"]) >= 3 and (s["told"] is None or when - s["told"] > 30)
        s["told"] = when if alert else s["told"]
        want[r["event_id"]] = (partner["path"], len(s["times"]), alert)
    got = pairing.write_new_then_unlink(table(spark, rows), 40, 30, 3, arrival=["arrived", "event_id"]).collect()
    assert {r["event_id"]: (r["partner"], r["n"], r["alert"]) for r in got} == want
    assert any(a for *_, a in want.values()) and any(n == 0 for _, n, _ in want.values())


def test_memory_files_in_either_order(spark):
    rng = random.Random(5)
    rows = []
    for i in range(900):
        runs = rng.random() < 0.3
        path = rng.choice(["/dev/fd/3", "/proc/self/fd/1", "/proc/7/fd/2", "/proc/8/fd/1", "/proc/self/fd/x", "/bin/sh"])
        rows.append(base(i, rng, type="exec" if runs else "memfd_create", fd=rng.randrange(3), image_path=path, comm=rng.choice(["memfd:a", "x"]), arrived=rng.randrange(2000)))
    want, states = {}, {}
    for r in sorted(rows, key=lambda r: (r["arrived"], r["event_id"])):
        s = states.setdefault((r["agent_id"], r["pid"]), {"made": [], "waits": None})
        if r["type"] == "memfd_create":
            s["made"] = [*s["made"], r][-8:]
            w = s["waits"]
            if w and w["n"] == r["fd"] and 0 <= w["ts_us"] - r["ts_us"] <= 10:
                want[w["event_id"]] = ("proc_fd", r["event_id"])
                s["waits"] = None
            continue
        if r["image_path"].startswith("/dev/fd/"):
            if r["comm"].startswith("memfd:"):
                want[r["event_id"]] = ("dev_fd", None)
            continue
        number = {"/proc/self/fd/1": 1, f"/proc/{r['pid']}/fd/2": 2, f"/proc/{r['pid']}/fd/1": 1}.get(r["image_path"])
        if number is None:
            continue
        met = [m for m in s["made"] if m["fd"] == number and 0 <= r["ts_us"] - m["ts_us"] <= 10]
        if met:
            want[r["event_id"]] = ("proc_fd", met[-1]["event_id"])
        else:
            s["waits"] = r | {"n": number}
    got = pairing.memfd_exec(table(spark, rows), 10, ["arrived", "event_id"]).collect()
    assert {r["event_id"]: (r["shape"], r["create_id"]) for r in got} == want and len(got) == len(want)


def test_shells_near_requests(spark):
    rng = random.Random(6)
    shells = [base(i, rng, type="exec", ts_us=rng.randrange(3000), parent_comm=rng.choice(["nginx", "php-fpm8.3", "sshd", None]), image_path=rng.choice(["/bin/sh", "bash", "/bin/ls", None])) for i in range(300)]
    asked = [base(1000 + i, rng, ts_us=rng.randrange(3000)) for i in range(60)]
    fits = [s for s in shells if s["parent_comm"] in ("nginx", "php-fpm8.3") and s["image_path"] in ("/bin/sh", "bash")]
    told = []
    for s in fits:
        near = [q for q in asked if q["agent_id"] == s["agent_id"] and abs(q["ts_us"] - s["ts_us"]) <= 12]
        key = lambda e: (e["ts_us"], e["event_id"])
        before, after = max((q for q in near if key(q) < key(s)), key=key, default=None), min((q for q in near if key(q) > key(s)), key=key, default=None)
        if before or after:
            q = before or after
            told.append((s["ts_us"] if before else q["ts_us"], s["ts_us"], s["event_id"], s, q))
    want, last = {}, {}
    for _, ts, i, s, q in sorted(told, key=lambda x: x[:3]):
        k = s["agent_id"], s["pid"]
        if k in last and same(last[k][1], s["process_generation"]) and ts - last[k][0] <= 12:
            continue
        last[k] = ts, s["process_generation"]
        want[i] = (q["event_id"], abs(q["ts_us"] - ts))
    got = pairing.web_shells(table(spark, shells), table(spark, asked).select("event_id", "tenant_id", "agent_id", "ts_us"), 12).collect()
    assert {r["event_id"]: (r["request_id"], r["delta_us"]) for r in got} == want and want
    assert pairing.web_shells(table(spark, shells), table(spark, asked).where("false").select("event_id", "tenant_id", "agent_id", "ts_us")).count() == 0


def test_components_read_the_events_once(spark, tmp_path):
    from wardlake.operators import graph

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    rows = [("t", f"a{i % 3}", "connect", "sh", "c:\\x", f"10.0.0.{i % 2}", "bash", 0, "/p", f"h{i}", "u", "success") for i in range(12)]
    ev = spark.createDataFrame(rows, "tenant_id string, agent_id string, type string, comm string, image_path string, daddr string, parent_comm string, flags int, path string, sha256 string, target_user string, outcome string")
    got = graph.entity_components(ev.mapInArrow(counted, ev.schema), str(tmp_path), 2).collect()
    assert read.value == 12 and got == []
