"""Digests that have to stay what they are."""

import pytest

import weftline as w
from weftline import identity


@pytest.fixture
def flow():
    with w.Flow("memory:") as f:
        yield f


@pytest.mark.parametrize(
    "value, digest",
    [
        (4, "ea204b5b8e9503514ea2778b53c8b7edbf9677d8"),
        (None, "9b22beedc52374a1bf1ed7e7a14745e14d040c6b"),
        ("wazza", "b10576aca8727dd5c685a4e9ebe4083eeec37e0c"),
        ([5, 4, 8, 9, 9, 10, 1, 3], "a0731e133c2cbad15a1ddaa09ad4e34d08c1ec90"),
        ({100: 9}, "40936fd438cb0faee5deed7edcc3b6aac2b49635"),
    ],
)
def test_constants(flow, value, digest):
    assert w.put(value).hash == digest


def test_steps(flow):
    assert w.shell("sleep 2; echo 👋 🪐").stdout.hash == "4138b9323081baf104b5dbe6c9ed52c185a8277f"
    assert w.reduce(sum, [3, 2]).hash == "80aa3ad2ba6813dc5b239fde702c1b3b9d146f22"
    date = w.shell("date")
    assert date.stdout.hash == "2406e5aafb26d62ff179657ed26c9f64a5f9b632"
    assert date.returncode.hash == "b6fa689ffa2de4305c4d496047b52031c9c32ff6"


def test_chain_of_steps(flow):
    update = w.reduce(lambda a, b: a, {100: 9}, [5, 4, 8, 9, 9, 10, 1, 3], name="reduce:test_integration.<locals>.update_data", out=w.Encoding.json)
    assert update.hash == "94f1d72a9335708b13514728659fe493dac13759"
    assert w.morph(lambda x: x, update, name="morph:test_integration.<locals>.sum_data").hash == "552e9dca6928975e5d89ef29ecc2836abf33bc65"
    assert w.morph(lambda x: x, 4, name="morph:test_integration.<locals>.make_secret").hash == "d5fab3c3284f971844606a27d456c066925d2eb2"


def test_not_the_bare_hash(flow):
    given = w.put([3, 2])
    step = identity.function(0, "reduce:sum", {"in0": "json"}, {"out0": "json"}, False)
    assert identity.variable("json", identity.operation(step, {"in0": given.hash}), "out0").startswith("2d56e")


def test_kinds_differ(flow):
    assert w.put("bla bla") != w.put(b"bla bla")
    assert w.put(b"bla bla") == w.put(b"bla bla")
