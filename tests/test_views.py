"""Signed-delta views against recomputation, after every step of a change log."""

from __future__ import annotations

import datetime as dt
import decimal
import random

import pytest

from vaultline.streaming import views as VW
from vaultline.streaming.deltas import DeltaLog, KeyedState

T0 = dt.datetime(2024, 1, 1)
TX = "op string, transaction_id string, account_number string, timestamp timestamp_ntz, amount decimal(15,2), change_ts timestamp_ntz, _seq long"
AC = "op string, account_number string, customer_id string, change_ts timestamp_ntz, _seq long"
CU = "op string, customer_id string, branch_name string, change_ts timestamp_ntz, _seq long"


class Model:
    """The three tables as dictionaries; the newest change of a key wins."""

    def __init__(self):
        self.t, self.a, self.c, self.seen = {}, {}, {}, {}

    def put(self, table, op, key, value, at):
        if at >= self.seen.get((id(table), key), at):
            self.seen[id(table), key] = at
            table.pop(key, None)
            if op != "DELETE":
                table[key] = value

    def view(self):
        out = {}
        for account, day, amount in self.t.values():
            branch = self.c.get(self.a.get(account))
            if branch is not None:
                n, s = out.get((day, branch), (0, decimal.Decimal(0)))
                out[day, branch] = n + 1, s + amount
        return out


def _rows(spark, rows, schema):
    return spark.createDataFrame(rows, schema) if rows else None


def test_view_equals_recomputation_after_each_batch(spark, tmp_path):
    """Random inserts, updates, moves and deletes of all three tables, some of
    them late, repeated, or for keys that are not there; folding and a replay."""
    rnd, model, clock = random.Random(4), Model(), 0
    view = VW.daily_view(spark, str(tmp_path / "v"), parts=2, fold_after=2)
    for batch in range(5):
        tx, ac, cu = [], [], []
        for _ in range(30 if batch else 90):
            clock += 1
            late = rnd.random() < 0.1
            at = (clock - rnd.randint(5, 30) if late else clock) if clock > 90 else clock
            when, op = T0 + dt.timedelta(seconds=at), rnd.choice(["INSERT", "UPDATE", "UPDATE", "UPDATE", "DELETE"] if batch else ["INSERT"])
            kind = rnd.random()
            if batch == 2 or kind < 0.5:
                k = f"T{rnd.randint(0, 25)}"
                v = (f"A{rnd.randint(0, 7)}", T0 + dt.timedelta(hours=rnd.randint(0, 90)), decimal.Decimal(rnd.randint(-500, 900)) / 100)
                tx.append((op, k, *(v if op != "DELETE" else (None, None, None)), when, clock))
                model.put(model.t, op, k, (v[0], v[1].date(), v[2]), (at, clock))
            elif kind < 0.75:
                k, v = f"A{rnd.randint(0, 7)}", f"C{rnd.randint(0, 4)}"
                ac.append((op, k, v if op != "DELETE" else None, when, clock))
                model.put(model.a, op, k, v, (at, clock))
            else:
                k, v = f"C{rnd.randint(0, 4)}", rnd.choice(["North", "South", "West"])
                cu.append((op, k, v if op != "DELETE" else None, when, clock))
                model.put(model.c, op, k, v, (at, clock))
        changes = dict(transactions=_rows(spark, tx, TX), accounts=_rows(spark, ac, AC), customers=_rows(spark, cu, CU))
        view.apply(batch, **changes)
        if batch == 3:
            view.apply(batch, **changes)  # once more after a failure
        got = {(r["transaction_date"], r["branch_name"]): (r["n"], r["s"]) for r in view.read("n", "s").collect()}
        assert got == model.view() and got, batch
    assert len(view.view.batches()) <= 4 and view.tx.batches() != list(range(5))


def test_moves_touch_only_their_keys_parts(spark, tmp_path):
    st = KeyedState(spark, str(tmp_path / "s"), "k", "v int", parts=16)
    at = T0
    st.apply(spark.createDataFrame([("INSERT", f"k{i}", i, at, i) for i in range(200)], "op string, k string, v int, change_ts timestamp_ntz, _seq long"), 0)
    d = st.apply(spark.createDataFrame([("UPDATE", "k7", 70, at, 500), ("DELETE", "k8", None, at, 501), ("UPDATE", "k9", 1, at, 1)],
                                       "op string, k string, v int, change_ts timestamp_ntz, _seq long"), 1)
    assert sorted(map(tuple, d.collect())) == [("k7", 7, -1), ("k7", 70, 1), ("k8", 8, -1)]  # the change of k9 is older than its row
    parts = st.parts_with(spark.createDataFrame([("k7",), ("k8",)], "k string"))
    read = st.read(2, parts)
    assert len(parts) <= 2 and "PartitionFilters: [" in read._jdf.queryExecution().toString()
    now = {r["k"]: r["v"] for r in st.live(st.read()).collect()}
    assert now == {f"k{i}": i for i in range(200) if i not in (7, 8)} | {"k7": 70}


def test_log_folds_and_replays(spark, tmp_path):
    log = DeltaLog(spark, str(tmp_path / "l"), "g string, n long", ["n"])
    assert log.read().collect() == [] and not log.fold(5)
    for b, rows in enumerate([[("a", 1), ("a", 2)], [("b", 5)], [("a", -3), ("c", 1)]]):
        log.write(spark.createDataFrame(rows, "g string, n long"), b)
        log.write(spark.createDataFrame(rows, "g string, n long"), b)
    want = {"b": 5, "c": 1}  # a sums to zero
    assert {r["g"]: r["n"] for r in log.read().collect()} == want
    assert log.fold(1, at_least=2) and log.batches() == [2] and not log.fold(1)
    assert {r["g"]: r["n"] for r in log.read().collect()} == want and {r["g"]: r["n"] for r in log.read(2).collect()} == {"a": 3, "b": 5}
    with pytest.raises(ValueError):
        log.read(before=1)
