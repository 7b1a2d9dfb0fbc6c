from datetime import date

import pytest

from clientela import constants as K
from clientela.params import Bounds, Period

DAY = date(2024, 3, 15)


@pytest.mark.parametrize(
    "name,start",
    [
        (K.LAST_30_DAYS, date(2024, 2, 14)),
        (K.LAST_90_DAYS, date(2023, 12, 16)),
        (K.LAST_12_MONTHS, date(2023, 3, 15)),
        (K.THIS_YEAR, date(2024, 1, 1)),
    ],
)
def test_presets(name, start):
    assert Period.preset(name, DAY) == Period(start, DAY)


def test_everything_is_unbounded():
    assert Period.preset(K.EVERYTHING, DAY) == Period(None, None)
    with pytest.raises(ValueError, match="months|ends"):
        Period(None, None).months


def test_unknown_preset_is_an_error():
    with pytest.raises(ValueError, match="something else"):
        Period.preset("something else", DAY)


def test_last_12_months_from_leap_day():
    assert Period.preset(K.LAST_12_MONTHS, date(2024, 2, 29)).start == date(2023, 2, 28)


def test_custom_period():
    assert Period.custom(DAY) == Period(date(2023, 12, 16), DAY)
    assert Period.custom(DAY, end=date(2024, 1, 1)).end == date(2024, 1, 1)
    assert Period(date(2023, 11, 30), date(2024, 2, 1)).months == 4


def test_objectives_keep_the_other_limits():
    own = Bounds(min_days=5, max_days=6, min_orders=2, max_orders=3, min_spend=7, max_spend=8)
    assert own.for_objective(K.CUSTOM) == own
    assert own.for_objective(K.REPURCHASE) == Bounds(30, 89, 1, 3, 0, 8)
    assert own.for_objective(K.VIP) == Bounds(0, None, 3, 3, 500, 8)
    assert own.for_objective(K.REACTIVATION) == Bounds(90, None, 1, 3, 0, 8)
