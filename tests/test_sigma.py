"""Rules as rows against a plain evaluation of each rule on each event."""

import random

from wardlake.operators import rules

EVENT = "event_id long, image_path string, cmdline string, parent_path string, extra array<string>"
RULE = "rule_id string, level string, field string, modifier string, value string"


def matches(text, how, value):
    if text is None:
        return False
    text, value = text.lower(), value.lower()
    if how in ("contains", "startswith", "endswith"):
        return {"contains": value in text, "startswith": text.startswith(value), "endswith": text.endswith(value)}[how]
    first, last, inner = value.startswith("*"), value.endswith("*"), value.strip("*")
    if first and last:
        return inner in text
    return text.endswith(inner) if first else text.startswith(inner) if last else text == value


def brute(events, rows):
    by_rule = {}
    for rule, level, field, how, value in rows:
        if value is not None:
            by_rule.setdefault((rule, level), {}).setdefault((field and field.lower(), (how or "").lower() if (how or "").lower() in ("contains", "startswith", "endswith") else ""), []).append(value)
    out = []
    for e in events:
        for (rule, _), groups in by_rule.items():
            ok = True
            for (field, how), values in groups.items():
                text = e.get(field or "cmdline")
                keyword = field is None
                ok &= any(matches(text, how or ("contains" if keyword and "*" not in v else ""), v) for v in values)
            if ok:
                out.append((e["event_id"], rule))
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abC.\\") for _ in range(rng.randint(1, 6)))
    events = [{"event_id": i, "image_path": rng.choice([None, "", word() + word()]), "cmdline": " ".join(word() for _ in range(5)) or None, "parent_path": rng.choice([None, word()])} for i in range(120)]
    rows = []
    for r in range(150):
        for _ in range(rng.randint(1, 3)):
            field = rng.choice(["Image_Path", "CMDLINE", "parent_path", "cmdline", None, "absent", "extra"][: 7 if rng.random() < 0.1 else 5])
            how = rng.choice([None, "", "Contains", "startswith", "endswith"]) if field else None
            for _ in range(rng.randint(1, 3)):
                value = word()[: rng.randint(0, 6)]
                rows.append((f"r{r}", "high", field, how, rng.choice([value, f"*{value}", f"{value}*", f"*{value}*", "*"]) if not how else value))
    rows.append(("rnull", "low", "cmdline", None, None))
    df = spark.createDataFrame([(e["event_id"], e["image_path"], e["cmdline"], e["parent_path"], ["x"]) for e in events], EVENT)
    got = rules.sigma(df, spark.createDataFrame(rows, RULE)).select("event_id", "rule_id").collect()
    want = brute(events, rows)
    assert sorted(map(tuple, got)) == want and len(want) > 100
    assert rules.sigma(df.where("false"), spark.createDataFrame(rows, RULE)).count() == 0
    assert rules.sigma(df, spark.createDataFrame([], RULE)).count() == 0


def test_twenty_thousand_rules(spark):
    rows = [(f"r{i}", "high", "cmdline", "contains", f"payload-{i:05d}-x") for i in range(20_000)] + [(f"r{i}", "high", "image_path", "endswith", "\\cmd.exe") for i in range(20_000)]
    events = [(i, "C:\\Windows\\CMD.exe" if i % 2 else "C:\\x.exe", f"run Payload-{i:05d}-X now", None, None) for i in range(300)]
    got = rules.sigma(spark.createDataFrame(events, EVENT), spark.createDataFrame(rows, RULE)).select("event_id", "rule_id").collect()
    assert sorted(map(tuple, got)) == [(i, f"r{i}") for i in range(1, 300, 2)]
