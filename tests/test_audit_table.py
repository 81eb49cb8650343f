"""The stored audit table: what changes, what stays as it is on disk, and what a lost job leaves."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from veilstream.operators import audit as A
from veilstream.operators import audit_table as S

START = datetime(2024, 1, 1)
KIND = "id string, tenant_id string, timestamp timestamp, event_type string, action_taken string, app_name string, domain string, user_identity string, finding_count int, synced int"


@pytest.fixture
def stored(spark, tmp_path):
    rows = [(str(i), ["007", "a b/c=d", None][i % 3], START + timedelta(hours=i), "e", "Warn", "x", "d", "u", 0, 0) for i in range(24 * 6)]
    events = spark.createDataFrame(rows, KIND).withColumn("findings", F.array().cast(A.FINDINGS))
    path = str(tmp_path / "audit")
    A.write_audit(events.coalesce(1), path, "key")
    return path, {r[0]: (r[1], r[2], 0) for r in rows}


def files(tmp_path):
    return {p.relative_to(tmp_path): p.stat().st_mtime_ns for p in (tmp_path / "audit").rglob("*.parquet")}


def read(spark, path):
    rows = S.stored(spark, path).collect()
    assert len({r.id for r in rows}) == len(rows)
    return {r.id: (r.tenant_id, r.timestamp, r.synced) for r in rows}


def test_marks_touch_their_folders_only(spark, stored, tmp_path):
    path, want = stored
    before = files(tmp_path)
    marked = ["0", "1", "30", "999"]
    S.mark_synced(spark, path, spark.createDataFrame([(i,) for i in [*marked, "0"]], "id string"))
    for i in marked[:3]:
        want[i] = (*want[i][:2], 1)
    assert read(spark, path) == want
    after = files(tmp_path)
    assert len(before.items() - after.items()) == len(after.items() - before.items()) == 3
    S.mark_synced(spark, path, spark.createDataFrame([("0",)], "id string"))  # marked already
    assert files(tmp_path) == after and not (tmp_path / "audit.staging").exists() or not list((tmp_path / "audit.staging").iterdir())


def test_purge_and_newest(spark, stored, tmp_path):
    path, want = stored
    before = files(tmp_path)
    cutoff = START + timedelta(days=2, hours=5)
    S.purge_before(spark, path, cutoff)
    want = {k: v for k, v in want.items() if v[1] >= cutoff}
    assert read(spark, path) == want
    kept = {f: t for f, t in files(tmp_path).items() if before.get(f) == t}
    assert len(kept) == 9 and not any("day=2024-01-01" in str(f) or "day=2024-01-02" in str(f) for f in files(tmp_path))
    S.keep_newest(spark, path, 12)
    want = {k: v for k, v in want.items() if v[1] >= START + timedelta(days=6) - timedelta(hours=36)}
    assert read(spark, path) == want
    S.retain(spark, path, START + timedelta(days=6), days=1, most=5)
    newest = sorted(((v[1], k) for k, v in want.items() if v[1] >= START + timedelta(days=5)), reverse=True)
    assert set(read(spark, path)) == {k for _, k in newest[:15]}
    S.purge_before(spark, path, START + timedelta(days=5, hours=23))
    assert set(read(spark, path)) == {newest[0][1]}


def test_a_lost_job_changes_nothing_or_is_completed(spark, stored, tmp_path, monkeypatch):
    path, want = stored
    before = files(tmp_path)
    ids = spark.createDataFrame([("5",)], "id string")
    monkeypatch.setattr(S, "_apply", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        S.mark_synced(spark, path, ids)
    monkeypatch.undo()
    assert read(spark, path) == want and files(tmp_path) == before
    (stage,) = (tmp_path / "audit.staging").iterdir()
    (tmp_path / "audit.staging" / "half" / "rows").mkdir(parents=True)  # staging that was never completed
    assert S.recover(spark, path) == 1
    want["5"] = (*want["5"][:2], 1)
    assert read(spark, path) == want and not list((tmp_path / "audit.staging").iterdir())
    assert S.recover(spark, path) == 0


def test_exports(spark):
    rows = spark.createDataFrame([("1", "t", START, "e", "Warn", "x", 'd "q"', "u", 0, 0), ("2", "t", START + timedelta(hours=1), "e", "Warn", "x", None, "u", 0, 1)], KIND)
    now = F.lit(START + timedelta(hours=2))
    signed = A.export(rows, "signed", "t", now, secret=b"k").first()
    assert signed.events == A.export(rows, "json", "t", now).first().events
    assert signed.signature == A.hmac.new(b"k", signed.events.encode(), "sha256").hexdigest()
    assert [e["id"] for e in A.json.loads(signed.events)] == ["1", "2"] and A.json.loads(signed.events)[0]["domain"] == 'd "q"'
    with pytest.raises(PermissionError):
        A.export(rows, "signed", "t", now)
    with pytest.raises(ValueError):
        A.export(rows, "xml", "t", now)
    with pytest.raises(Exception, match="more than 1 events"):
        A.json_array(rows, most=1).collect()


def test_staged_folders_are_moved_also_after_a_job_lost_between(spark, stored, tmp_path, monkeypatch):
    path, want = stored
    apply, staged = S._apply, []

    def lost(spark, path, stage):
        staged.extend(sorted((tmp_path / "audit.staging").rglob("*.parquet")))
        rows = [p.parent for p in staged if "rows" in p.parts]
        place = tmp_path / "audit" / rows[0].relative_to(rows[0].parent.parent)
        S._files(spark, path)[1].delete(S._files(spark, str(place))[0], True)
        rows[0].rename(place)  # one folder was moved, then the job was lost
        raise RuntimeError("lost")

    monkeypatch.setattr(S, "_apply", lost)
    with pytest.raises(RuntimeError, match="lost"):
        S.mark_synced(spark, path, spark.createDataFrame([("5",), ("7",), ("8",)], "id string"))
    monkeypatch.setattr(S, "_apply", apply)
    assert S.recover(spark, path) == 1
    for i in ("5", "7", "8"):
        want[i] = (*want[i][:2], 1)
    assert read(spark, path) == want
    assert {p.name for p in staged if "rows" in p.parts} <= {p.name for p in files(tmp_path)}
