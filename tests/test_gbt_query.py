import pytest

from newsloom.plans import market


def test_the_registered_query_fits_the_models_own_number_of_trees(spark, sf_dir, monkeypatch):
    class Seen(Exception):
        pass

    real = market.model.get_model

    def asked(*args, **options):
        raise Seen(real(*args, **options).estimator.getMaxIter())

    monkeypatch.setattr(market.model, "get_model", asked)
    with pytest.raises(Seen) as seen:
        market.gbt_train_predict(spark, sf_dir)
    assert seen.value.args == (200,)
