import pytest

from keelson.plans import pipelines

from .conftest import SF_SMALL


class _Seen(Exception):
    pass


@pytest.mark.parametrize("run, step", [(pipelines.diabetes_style, "undersample_balance"), (pipelines.diabetes_style, "split_exact"),
                                       (pipelines.fraud_style, "split_exact"), (pipelines.passenger_style, "split_exact")])
def test_steps_that_reread_their_input_get_a_checkpoint(spark, monkeypatch, run, step):
    """the joins of the orders, their lines and customers run once, not once per reading."""
    def seen(df, *args, **kw):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
        raise _Seen

    monkeypatch.setattr(pipelines.sample, step, seen)
    with pytest.raises(_Seen):
        run(spark, SF_SMALL)
