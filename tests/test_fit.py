"""Training step: hand-derived gradients against finite differences; loss falls on Spark."""
import numpy as np
import pytest

from lodestar.operators import fit


def _params(rng, v=12, d=5, h=4):
    return {"embed": np.vstack([np.zeros(d), rng.normal(size=(v - 1, d))]), "fc_weight": rng.normal(size=(h, d)),
            "fc_bias": rng.normal(size=(1, h)), "bn_weight": 1 + 0.1 * rng.normal(size=(1, h)),
            "bn_bias": 0.1 * rng.normal(size=(1, h)), "bn_mean": np.zeros((1, h)), "bn_var": np.ones((1, h))}


@pytest.mark.parametrize("shared", [True, False])
def test_gradients_match_finite_differences(shared):
    rng = np.random.default_rng(7)
    cp = _params(rng)
    qp = cp if shared else _params(rng)
    ci = rng.integers(0, 12, size=(5, 6))
    qi = rng.integers(0, 12, size=(5, 3))
    loss, cg, qg, _ = fit.loss_and_grads(cp, qp, ci, qi)
    for p, g in ((cp, cg), (qp, qg)):
        for k in fit.PARAMS:
            it = np.nditer(p[k], flags=["multi_index"])
            checked = 0
            for _ in it:
                idx = it.multi_index
                if k == "embed" and idx[0] == 0:
                    continue
                if k == "embed":
                    # scale_grad_by_freq: the analytic gradient is scaled, finite differences are not
                    continue
                old = p[k][idx]
                p[k][idx] = old + 1e-6
                up = fit.loss_and_grads(cp, qp, ci, qi)[0]
                p[k][idx] = old - 1e-6
                down = fit.loss_and_grads(cp, qp, ci, qi)[0]
                p[k][idx] = old
                assert g[k][idx] == pytest.approx((up - down) / 2e-6, abs=1e-5), (k, idx)
                checked += 1
                if checked > 12:
                    break


def test_embedding_gradient_with_unique_tokens():
    """With every token used once per call, frequency scaling is 1 and finite differences apply."""
    rng = np.random.default_rng(3)
    cp = _params(rng, v=40)
    ci = np.arange(1, 21).reshape(4, 5)
    qi = np.arange(21, 33).reshape(4, 3)
    _, g, _, _ = fit.loss_and_grads(cp, cp, ci, qi)
    for row in (1, 7, 22, 30):
        for col in range(2):
            old = cp["embed"][row, col]
            cp["embed"][row, col] = old + 1e-6
            up = fit.loss_and_grads(cp, cp, ci, qi)[0]
            cp["embed"][row, col] = old - 1e-6
            down = fit.loss_and_grads(cp, cp, ci, qi)[0]
            cp["embed"][row, col] = old
            assert g["embed"][row, col] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_loss_falls_over_epochs(spark):
    from lodestar.plans import fixtures as fx
    from lodestar.plans.end_to_end import prepare_training
    from tests.conftest import SF01
    batched, _ = prepare_training(fx.text_pairs(spark, SF01))
    batched = batched.checkpoint(eager=True)
    _, metrics = fit.nbow_fit(batched, embedding_dim=16, encoding_dim=16, lr=0.01, epochs=3,
                              batches_per_step=2, dropout=0.0)
    per_epoch = [v for (_, _, e, name, v) in metrics if name == "train/loss"]
    assert len(per_epoch) == 3 and per_epoch[-1] < per_epoch[0]



def test_run_sweep_picks_lowest_validation_loss(spark):
    from lodestar.operators import train
    from lodestar.plans import fixtures as fx
    from lodestar.plans.end_to_end import prepare_training, validate
    from tests.conftest import SF001
    batched, _ = prepare_training(fx.text_pairs(spark, SF001))
    batched = batched.checkpoint(eager=True)
    trials = train.sweep_trials(spark.createDataFrame([(1,), (2,)], "run_id long"))

    def vfn(weights):
        r = validate(batched, weights).first()
        return r["valid_loss"], r["valid_mrr"]

    out = fit.run_sweep(batched, trials, vfn, epochs=1, max_batches=2, batches_per_step=2)
    rows = out.collect()
    assert len(rows) == 2 and sum(r["is_best"] for r in rows) == 1
    best = [r for r in rows if r["is_best"]][0]
    assert best["valid_loss"] == min(r["valid_loss"] for r in rows)


def test_f7_a_step_passes_each_mini_batch_once_and_adds_its_gradients(spark, tmp_path, monkeypatch):
    """Three mini-batches in steps of two, against a plain loop over the rows that the kernel saw."""
    rng = np.random.default_rng(11)
    rows = [(i, "train", i, 0, rng.integers(0, 30, 6).tolist(), rng.integers(0, 30, 4).tolist()) for i in range(25)]
    batched = spark.createDataFrame(rows, "row_id long, split string, split_pos long, batch_id long, code_ids array<int>, query_ids array<int>")
    kernel, seen = fit._step_kernel, str(tmp_path)

    def noted(*args):
        run = kernel(*args)

        def call(pdf):
            import uuid
            rows = pdf.sort_values("row_id")
            np.savez(f"{seen}/{rows['batch_id'].iloc[0]}-{uuid.uuid4().hex}", c=np.stack(rows["code_ids"]), q=np.stack(rows["query_ids"]))
            return run(pdf)
        return call

    monkeypatch.setattr(fit, "_step_kernel", noted)
    towers, metrics = fit.nbow_fit(batched, vocab_size=30, embedding_dim=8, encoding_dim=4, batches_per_step=2, dropout=0.0)
    calls = sorted(tmp_path.iterdir())
    assert [c.name.split("-")[0] for c in calls] == ["0", "1", "2"]
    plain, opt, losses = fit._init_params(spark, "shared", 30, 8, 4), fit.AdamW(), []
    for step in (calls[:2], calls[2:]):
        total = {k: np.zeros_like(plain[k]) for k in fit.PARAMS}
        for call in map(np.load, step):
            loss, grads, _, _ = fit.loss_and_grads(plain, plain, call["c"].astype(np.int64), call["q"].astype(np.int64))
            losses.append(loss)
            for k in total:
                total[k] += grads[k]
        opt.step(plain, {k: g / len(step) for k, g in total.items()})
    for k in fit.PARAMS:
        assert np.allclose(towers["shared"][k], plain[k], rtol=0, atol=1e-12), k
    assert [v for _, _, _, name, v in metrics if name == "train/batch_loss"] == pytest.approx(losses, abs=1e-12)


def test_f7_no_training_rows(spark):
    batched = spark.createDataFrame([], "row_id long, split string, split_pos long, batch_id long, code_ids array<int>, query_ids array<int>")
    towers, metrics = fit.nbow_fit(batched, vocab_size=30, embedding_dim=8, encoding_dim=4)
    assert metrics == [] and towers["shared"]["embed"].shape == (30, 8)


def _rows(spark, n, seed=5, vocab=30):
    rng = np.random.default_rng(seed)
    rows = [(i, "train", i, 0, rng.integers(0, vocab, 6).tolist(), rng.integers(0, vocab, 4).tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, split string, split_pos long, batch_id long, code_ids array<int>, query_ids array<int>")


def test_f1_a_step_is_one_job_of_one_stage(spark):
    """Thirty steps may not take more than a job each, beside those of the epoch."""
    batched, sc = _rows(spark, 300).checkpoint(eager=True), spark.sparkContext
    sc.setJobGroup("f1-steps", "thirty steps")
    try:
        _, metrics = fit.nbow_fit(batched, vocab_size=30, embedding_dim=8, encoding_dim=4, batches_per_step=1)
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    assert sum(name == "train/batch_loss" for _, _, _, name, _ in metrics) == 30
    assert len(sc.statusTracker().getJobIdsForGroup("f1-steps")) < 45


def test_f1_lanes_of_several_mini_batches_add_up(spark):
    """A step of more mini-batches than lanes, the last one short, against the same step with a lane each."""
    batched = _rows(spark, 375).checkpoint(eager=True)
    options = dict(vocab_size=30, embedding_dim=8, encoding_dim=4, dropout=0.2, shared=False)
    wide, one = fit.LANES, fit.nbow_fit(batched, batches_per_step=38, **options)
    try:
        fit.LANES = 38
        other = fit.nbow_fit(batched, batches_per_step=38, **options)
    finally:
        fit.LANES = wide
    assert wide < 38 and [m[3] for m in one[1]] == [m[3] for m in other[1]] and len(one[1]) == 39
    assert [m[4] for m in one[1]] == pytest.approx([m[4] for m in other[1]], abs=1e-12)
    for t in ("code", "query"):
        for k in fit.PARAMS:
            assert np.allclose(one[0][t][k], other[0][t][k], rtol=0, atol=1e-9), (t, k)


def test_f1_gradients_of_unpickled_weights_are_as_fast_and_equal():
    import pickle
    rng = np.random.default_rng(2)
    p = _params(rng, v=60, d=16)
    ci, qi = rng.integers(0, 60, size=(10, 40)), rng.integers(0, 60, size=(10, 8))
    q = pickle.loads(pickle.dumps(p, 5))
    _, plain, _, _ = fit.loss_and_grads(p, p, ci, qi)
    _, sent, _, _ = fit.loss_and_grads(q, q, ci, qi)
    assert all((plain[k] == sent[k]).all() for k in fit.PARAMS)
    flat = sent["embed"].dtype
    assert flat is np.dtype(np.float64)          # another object of the same type sends add.at down a path forty times slower
