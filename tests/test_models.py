import numpy as np
import pytest
from pyspark.sql import functions as F

from ratewell.models import training
from ratewell.models import scoring
from ratewell.models.network import (
    NetworkConfig,
    forward,
    gradients,
    initial_params,
    task_losses,
)
from ratewell.models.parameters import ParameterTable, fit_by_table
from ratewell.models.scoring import MultiTaskModel, evaluate
from ratewell.models.training import (
    AdamW,
    MultiTaskTrainer,
    TrainConfig,
    TrainState,
    deal_batches,
    step_rows,
    total_gradient,
)
from ratewell.operators.features import with_vectors
from ratewell.sources.readers import read_epoch_log, read_run_config, read_test_report

SHAPES = [
    NetworkConfig("ple", 3, 4, 5, 2, 1, 2),
    NetworkConfig("mmoe", 3, 4, 5, 1, num_experts=3),
    NetworkConfig("mmoe", 3, 5, 4, 3, num_experts=2),
]


def data(n=40, d=3, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)).astype(np.float32)
    y = np.stack([x[:, 0] + x[:, 1] > 0, x[:, 2] > 0.3], axis=1).astype(int)
    return x, y


def frame(spark, x, y):
    rows = [(i, v.tolist(), int(a), int(b)) for i, (v, (a, b)) in enumerate(zip(x, y))]
    schema = "key long, x array<float>, y_income tinyint, y_never_married tinyint"
    return spark.createDataFrame(rows, schema)


def row_by_row(config, p, x):
    """The network written out one row and one expert at a time."""
    out = []
    for v in x.astype(float):
        selectors = {"income": v, "never": v}
        for level in range(1, config.num_levels + 1):
            experts = []
            for e in range(config.experts):
                h = np.array([max(0.0, a) for a in v @ p[f"{level}.hidden.weight"][e] + p[f"{level}.hidden.bias"][e, 0]])
                o = h @ p[f"{level}.out.weight"][e] + p[f"{level}.out.bias"][e, 0]
                o = (o - np.mean(o)) / np.sqrt(np.mean((o - np.mean(o)) ** 2) + 1e-5)
                experts.append(o * p[f"{level}.norm.weight"][e, 0] + p[f"{level}.norm.bias"][e, 0])
            mixed = {}
            for t, s in selectors.items():
                a = np.exp(s @ p[f"{level}.gate.{t}.weight"] + p[f"{level}.gate.{t}.bias"])
                mixed[t] = sum(w * o for w, o in zip(a / a.sum(), experts))
            selectors = mixed
        logits = []
        for t, s in selectors.items():
            u = np.maximum(s @ p[f"tower.{t}.hidden.weight"] + p[f"tower.{t}.hidden.bias"], 0)
            logits.append(float((u @ p[f"tower.{t}.out.weight"])[0] + p[f"tower.{t}.out.bias"][0]))
        out.append(logits)
    return np.array(out)


@pytest.mark.parametrize("config", SHAPES)
def test_gradients_against_finite_differences(config):
    x, y = data(12)
    x, y = x.astype(float), y.astype(float)
    weights, tasks = np.array([2.0, 0.7]), np.array([1.0, 0.5])
    rng = np.random.default_rng(1)
    p = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in initial_params(config, 0).items()}

    def loss():
        return float((task_losses(forward(config, p, x)[0], y, weights)[0] * tasks).sum())

    logits, levels = forward(config, p, x)
    g = gradients(config, p, x, levels, task_losses(logits, y, weights)[1] * tasks)
    assert sorted(g) == sorted(config.trained())
    for name in g:
        assert g[name].shape == p[name].shape
        for i in rng.choice(p[name].size, min(4, p[name].size), replace=False):
            at = np.unravel_index(i, p[name].shape)
            kept, h = p[name][at], 1e-6
            p[name][at] = kept + h
            up = loss()
            p[name][at] = kept - h
            down = loss()
            p[name][at] = kept
            assert g[name][at] == pytest.approx((up - down) / (2 * h), rel=1e-4, abs=1e-6), name


@pytest.mark.parametrize("config", SHAPES)
def test_scoring_equals_the_row_by_row_network(spark, config, monkeypatch):
    monkeypatch.setattr(scoring, "_ROWS", 7)
    x, y = data(30)
    model = MultiTaskModel.fresh(config, 3)
    rows = model.score(frame(spark, x, y).repartition(3)).orderBy("key").collect()
    got = np.array([[r["logit_income"], r["logit_never"]] for r in rows])
    assert got == pytest.approx(row_by_row(config, model.params, x), abs=1e-9)


def test_task_code_travels_without_the_library(tmp_path):
    """Executors that do not have this package can run what tasks need of it."""
    import subprocess
    import sys

    from pyspark import cloudpickle

    payload = tmp_path / "code"
    payload.write_bytes(cloudpickle.dumps((forward, gradients, NetworkConfig, scoring.feature_blocks)))
    load = "import pickle, sys; f = pickle.load(open(sys.argv[1], 'rb')); f[2]('mmoe', 3)"
    subprocess.run([sys.executable, "-c", load, str(payload)], cwd=tmp_path, check=True)


def test_start_values():
    p = initial_params(NetworkConfig("ple", 100, 8, 16), 0)
    w = p["1.hidden.weight"]
    assert w.shape == (6, 100, 16) and np.abs(w).max() <= 0.1 and np.abs(w).max() > 0.099
    assert not p["1.hidden.bias"].any() and (p["1.norm.weight"] == 1).all()


def test_number_of_parameters():
    def size(c):
        return sum(int(np.prod(s)) for s, _ in c.layout().values())

    d, h, m = 500, 256, 128
    expert = d * h + h + h * m + m + 2 * m
    tower = m * (m // 2) + m // 2 + m // 2 + 1
    ple = 12 * expert + 3 * (d * 6 + 6) + 3 * (m * 6 + 6) + 2 * tower
    assert size(NetworkConfig("ple", d)) == ple
    assert size(NetworkConfig("mmoe", d, num_levels=1)) == 4 * expert + 2 * (d * 4 + 4) + 2 * tower


def test_shape_limits():
    for bad in (dict(kind="ple", num_levels=3), dict(kind="mmoe", num_levels=0),
                dict(kind="mmoe", num_experts=0), dict(kind="other")):
        with pytest.raises(ValueError):
            NetworkConfig(**{"d_in": 3, **bad})


def test_gates_sum_to_one(spark):
    x, y = data(10)
    model = MultiTaskModel.fresh(SHAPES[0])
    for r in model.gate_weights(frame(spark, x, y), level=2).collect():
        assert len(r["gate_income"]) == 5 and sum(r["gate_never"]) == pytest.approx(1.0)


def test_gradient_does_not_depend_on_partitions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("ratewell.models.training.CHUNK", 17)
    x, y = data(200)
    model = MultiTaskModel.fresh(SHAPES[0], 1)
    found = []
    for partitions in (1, 4):
        df = frame(spark, x, y).repartition(partitions)
        found.append(total_gradient(step_rows(df, model, (2.0, 1.0), (1.0, 1.0), (0,)), model))
    assert found[0][1] == found[1][1] == 200
    assert found[0][0] == pytest.approx(found[1][0], rel=1e-9, abs=1e-9)


def test_optimizer_step():
    opt = AdamW(2, 0.1, 1.0)
    got = opt.step(np.array([1.0, -2.0]), np.array([3.0, 4.0]), 0.01)
    # the first step moves every parameter by the rate, after the decay
    assert got == pytest.approx([0.999 - 0.01, -1.998 - 0.01], abs=1e-6)


def test_batches_cover_every_bucket_once():
    first, second = deal_batches(42, 1, range(64), 8), deal_batches(42, 2, range(64), 8)
    assert sorted(b for part in first for b in part) == list(range(64))
    assert first != second and first == deal_batches(42, 1, range(64), 8)


@pytest.mark.parametrize("kind", ["ple", "mmoe"])
def test_training_learns_and_resumes(spark, tmp_path, kind):
    x, y = data(1_200)
    df = frame(spark, x, y).repartition(4).cache()
    train, val, test = (df.where(F.col("key") % 4 == i) for i in range(3))
    config = TrainConfig(
        kind=kind, epochs=3, batches_per_epoch=3, buckets=12, d_model=8, expert_hidden=8,
        num_experts=2, num_shared_experts=1, num_task_experts=1, dropout=0.05, lr=0.03,
    )
    out = str(tmp_path / "run")
    result = MultiTaskTrainer(config).fit(train, val, test, out)
    assert result.test["combined_auc"] > 0.8
    log = read_epoch_log(spark, f"{out}/metrics").orderBy("epoch").collect()
    assert [r["epoch"] for r in log] == [1, 2, 3]
    assert {r["run"] for r in log} == {result.run}
    assert log[-1]["lr"] == pytest.approx(0.0, abs=1e-12)
    assert log[0]["val"]["combined_auc"] == pytest.approx(result.log[0]["val"]["combined_auc"])
    report = read_test_report(spark, f"{out}/report").first()
    assert report["best_val_combined_auc"] == pytest.approx(result.best_score)
    assert read_run_config(spark, f"{out}/config").first()["d_in"] == 3
    loaded = MultiTaskModel.load(spark, f"{out}/model")
    again = evaluate(loaded, test, (1.0, 1.0)).first()
    assert again["combined_auc"] == pytest.approx(result.test["combined_auc"])
    if kind == "ple":
        start = MultiTaskModel.fresh(config.network(3), config.seed).params
        name = "2.gate.shared.weight"
        assert (loaded.params[name] == start[name]).all()
        resumed = MultiTaskTrainer(config).fit(train, val, init=loaded)
        assert resumed.log[0]["val"]["combined_auc"] > log[0]["val"]["combined_auc"] - 0.05


def test_batch_means_and_exact_metrics_agree_on_one_batch(spark):
    x, y = data(60)
    df = frame(spark, x, y)
    model = MultiTaskModel.fresh(SHAPES[1], 5)
    exact = evaluate(model, df, (2.0, 3.0)).first()
    batched = evaluate(model, df, (2.0, 3.0), batch_size=60).first()
    assert tuple(exact) == pytest.approx(tuple(batched))


def test_loading_prefers_best_and_skips_torn_versions(spark, tmp_path):
    path = str(tmp_path / "m")
    first, second, last = (MultiTaskModel.fresh(SHAPES[1], seed) for seed in range(3))
    last.save(spark, path, "last", 2)
    name = "1.hidden.weight"
    assert (MultiTaskModel.load(spark, path).params[name] == last.params[name]).all()
    first.save(spark, path, "best", 1)
    second.save(spark, path, "best", 2)
    assert (MultiTaskModel.load(spark, path).params[name] == second.params[name]).all()
    torn = second.table(spark).where("param != '1.out.bias'")
    torn.write.mode("overwrite").parquet(f"{path}/params/tag=best/version=3")
    assert (MultiTaskModel.load(spark, path).params[name] == first.params[name]).all()
    with pytest.raises(FileNotFoundError):
        MultiTaskModel.load(spark, path, ["other"])


def test_incomplete_model_is_refused(spark):
    model = MultiTaskModel.fresh(SHAPES[1])
    with pytest.raises(ValueError, match="incomplete"):
        MultiTaskModel.from_table(model.table(spark).where("param != '1.out.bias'"), model.config)


def test_every_row_is_trained_on_whatever_the_buckets(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).astype(np.float32).tolist(), i % 2, i % 3 // 2) for i in range(400)]
    df = spark.createDataFrame(rows, "key long, x array<float>, y_income tinyint, y_never_married tinyint")
    written = training.with_buckets(df, 32)
    config = TrainConfig("mmoe", 1, 3, 8, d_model=4, expert_hidden=4, num_experts=2)
    seen = []
    total = training.total_gradient
    monkeypatch.setattr(training, "total_gradient", lambda r, m: seen.append(total(r, m)[1]) or total(r, m))
    MultiTaskTrainer(config).fit(written, df)
    assert sum(seen) == 400
    with pytest.raises(ValueError, match="4 to 4"):
        MultiTaskTrainer(config).fit(written, df, init=MultiTaskModel.fresh(config.network(5)))


def test_dropout_does_not_depend_on_partitions(spark):
    rng = np.random.default_rng(4)
    rows = [(rng.normal(size=3).astype(np.float32).tolist(), i % 2, i % 3 // 2) for i in range(90)]
    df = spark.createDataFrame(rows, "x array<float>, y_income tinyint, y_never_married tinyint")
    model = MultiTaskModel.fresh(TrainConfig("ple", d_model=4, expert_hidden=6, dropout=0.5).network(3))
    one, many = (
        training.batch_gradient(df.repartition(n), model, seed=(1, 2, 3)) for n in (1, 4)
    )
    assert all(np.allclose(one[k], many[k]) for k in one)
    other = training.batch_gradient(df, model, seed=(1, 2, 4))
    assert any(not np.allclose(one[k], other[k]) for k in one)
    draws = training.RowDraws(np.arange(1, 2000)).random((2, 1999, 5))
    assert abs(draws.mean() - 0.5) < 0.01 and abs(draws.std() - 12**-0.5) < 0.01


def test_a_later_run_is_the_newer_one(spark, tmp_path):
    config = TrainConfig("mmoe", d_model=4, expert_hidden=4, num_experts=2).network(3)
    early, late = MultiTaskModel.fresh(config, 1), MultiTaskModel.fresh(config, 2)
    path = str(tmp_path / "model")
    early.save(spark, path, "best", 5)
    late.save(spark, path, "best", 1)
    name = next(iter(early.params))
    assert (MultiTaskModel.load(spark, path).params[name] == late.params[name]).all()


def test_vectors_of_unequal_width_are_errors(spark):
    df = spark.createDataFrame([(1, [1.0] * 63), (2, [1.0] * 65)], "key long, x array<float>").coalesce(1)
    model = MultiTaskModel.fresh(TrainConfig("mmoe", d_model=4, expert_hidden=4, num_experts=2).network(64))
    with pytest.raises(Exception, match="not 64 wide"):
        model.score(df, ("key",)).collect()


def sparse_and_dense(spark, n=300, cells=2, slots=7, seed=5):
    """The same rows as sparse rows and as vectors; some rows have no slot."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        places = sorted({int(p) for p in rng.integers(cells, cells + slots - 1, rng.integers(0, 4))})
        rows.append((i, cells + slots, [float(np.float32(c)) for c in rng.normal(size=cells)], places, i % 2, i % 3 // 2))
    schema = "key long, width int, numeric array<float>, slots array<int>, y_income tinyint, y_never_married tinyint"
    sparse = spark.createDataFrame(rows, schema).repartition(3)
    return sparse, with_vectors(sparse).drop("width", "numeric", "slots")


@pytest.mark.parametrize("config", [
    NetworkConfig("ple", 9, 4, 5, 2, 1, 2), NetworkConfig("mmoe", 9, 4, 5, 1, num_experts=3),
    NetworkConfig("mmoe", 9, 5, 4, 3, num_experts=2),
])
def test_sparse_rows_score_and_learn_as_their_vectors(spark, config, monkeypatch):
    monkeypatch.setattr("ratewell.models.training.CHUNK", 17)
    sparse, vectors = sparse_and_dense(spark)
    model = MultiTaskModel.fresh(config, 1)
    scores = [{r["key"]: r[2:] for r in model.score(df, ("key", "y_income")).collect()} for df in (sparse, vectors)]
    assert all(scores[0][k] == pytest.approx(scores[1][k], abs=1e-12) for k in scores[1])
    found = [training.batch_gradient(df, model, (2.0, 1.0)) for df in (sparse, vectors)]
    assert all(np.allclose(found[0][n], found[1][n], atol=1e-12) for n in found[1])


def test_sums_that_move_follow_the_slots_met(spark):
    config = NetworkConfig("mmoe", 5_002, 4, 5, 1, num_experts=3)
    sparse, _ = sparse_and_dense(spark)
    wide = sparse.withColumn("width", F.lit(5_002))
    rows = step_rows(wide, MultiTaskModel.fresh(config, 1), (1.0, 1.0), (1.0, 1.0), (0,)).where("kind != 'score'")
    cells = rows.agg(F.sum(F.size("values"))).first()[0]
    assert cells < 3 * (6 * (3 * 5 + 2 * 3) + 400)
    slots = {r["chunk"] for r in rows.where("kind = 'slot'").collect()}
    assert slots == {s for r in sparse.collect() for s in r["slots"]}


def test_slots_out_of_place_are_errors(spark):
    sparse, _ = sparse_and_dense(spark, 5)
    model = MultiTaskModel.fresh(NetworkConfig("mmoe", 9, 4, 5, 1, num_experts=3), 1)
    for column, value in (("slots", F.array(F.lit(9))), ("slots", F.lit(None).cast("array<int>"))):
        with pytest.raises(Exception, match="slot|null"):
            model.score(sparse.withColumn(column, value), ("key",)).collect()


def test_table_steps_equal_the_drivers(spark, tmp_path):
    """Two clipped steps over all parameters."""
    sparse, _ = sparse_and_dense(spark)
    model = MultiTaskModel.fresh(NetworkConfig("ple", 9, 4, 5, 2, 1, 2), 1)
    names = model.config.trained()
    table = ParameterTable.create(spark, model, 2, str(tmp_path / "p"))
    driver = AdamW(sum(model.params[n].size for n in names), 0.1, 0.05)
    for i in range(2):
        batch = sparse.where(F.col("key") % 3 == i)
        rows = step_rows(batch, table.model_for(batch), (2.0, 1.0), (1.0, 1.0), (0, i))
        n = batch.count()
        table.step(training.gradient_sums(rows), n, 0.01, driver)
        gradient, seen = total_gradient(step_rows(batch, model, (2.0, 1.0), (1.0, 1.0), (0, i)), model)
        assert seen == n and np.linalg.norm(gradient / n) > 0.05  # it is clipped
        flat = driver.step(training._flat(model.params, names), gradient / n, 0.01)
        model = MultiTaskModel(model.config, training._unflat(flat, model.params, names))
    again = ParameterTable.load(spark, str(tmp_path / "p"))
    assert (again.version, again.steps) == (2, 2)
    for got in (table.model(), again.model()):
        assert all(np.allclose(got.params[n], model.params[n], rtol=1e-9, atol=1e-12) for n in names)


def test_training_by_table_equals_training_on_the_driver(spark, tmp_path):
    sparse, _ = sparse_and_dense(spark, 240)
    train, val = (training.with_buckets(sparse, 4), sparse.where("key % 5 = 0"))
    config = TrainConfig("mmoe", 2, 2, 4, lr=0.02, d_model=4, expert_hidden=5, num_experts=3, dropout=0.0)
    start = MultiTaskModel.fresh(config.network(9), 3)
    trainer = MultiTaskTrainer(config)
    want = trainer.fit(train, val, init=start)
    got = fit_by_table(trainer, ParameterTable.create(spark, start, 2, str(tmp_path / "p")), train, val)
    assert [e["epoch"] for e in got.log] == [1, 2]
    for a, b in zip(got.log, want.log):
        assert all(a[part][m] == pytest.approx(b[part][m], rel=1e-9) for part in ("train", "val") for m in a[part])
    assert all(np.allclose(got.table.model().params[n], want.last.params[n], atol=1e-10) for n in start.config.trained())


def test_fresh_tables_draw_within_bounds(spark, tmp_path, monkeypatch):
    config = NetworkConfig("mmoe", 300, 4, 5, 1, num_experts=3)
    model = ParameterTable.fresh(spark, config, 2, 7, str(tmp_path / "p")).model()
    for n in config.wide():
        assert np.abs(model.params[n]).max() <= 300**-0.5 and model.params[n].std() == pytest.approx((900) ** -0.5, rel=0.1)
    sparse, _ = sparse_and_dense(spark, 20)
    monkeypatch.setattr("ratewell.models.parameters.SLOT_BYTES", 100)
    with pytest.raises(ValueError, match="more batches"):
        ParameterTable.load(spark, str(tmp_path / "p")).model_for(sparse)


def test_two_and_two_epochs_are_four(spark, tmp_path):
    sparse, _ = sparse_and_dense(spark, 240)
    train, val = training.with_buckets(sparse, 4), sparse.where("key % 5 = 0")
    config = TrainConfig("ple", 4, 2, 4, lr=0.02, d_model=4, expert_hidden=5, num_shared_experts=1, num_task_experts=1)
    trainer = MultiTaskTrainer(config)
    whole = trainer.fit(train, val)
    out = str(tmp_path / "run")
    first = trainer.fit(train, val, out=out, until=2)
    assert [e["epoch"] for e in first.log] == [1, 2]
    state = TrainState.load(spark, f"{out}/model", config)
    assert state.epoch == 2 and state.optimizer.steps == 4
    second = trainer.fit(train, val, init=state)
    assert second.run == first.run != whole.run
    assert [e["epoch"] for e in second.log] == [3, 4]
    assert all((second.last.params[n] == whole.last.params[n]).all() for n in whole.last.params)
    assert all((second.model.params[n] == whole.model.params[n]).all() for n in whole.model.params)
    assert second.best_epoch == whole.best_epoch
    first.model.save(spark, f"{out}/other", "last", 1)
    with pytest.raises(FileNotFoundError, match="without an optimizer"):
        TrainState.load(spark, f"{out}/other", config)
