import time

import pytest

import weftline as w
from weftline import codec, draw, infer, mustache, running
from weftline.__main__ import main
from weftline.model import ArtefactStatus, Function, How, RunStatus
from weftline.sources.store import FileStore, MemoryStore, open_store


@pytest.fixture
def flow():
    with w.Flow("memory:") as f:
        yield f


def done(x, **kw):
    w.execute(x)
    return w.take(x, **kw)


def upper_lower(x: str) -> tuple[str, str]:
    return x.upper(), x.lower()


def test_values(flow):
    for value in ("bla bla", b"bla bla", [1, 2, 3], {"fun": 3}, 1.5, True, None):
        assert w.take(w.put(value)) == value
    with pytest.raises(TypeError):
        w.put({1, 2})


def test_codec():
    assert codec.encode(w.Encoding.blob, "what").kind is w.ErrorKind.WrongType
    assert codec.encode(w.Encoding.json, {1}).kind is w.ErrorKind.JSONEncodingError
    assert codec.decode(w.Encoding.json, b"{", "x").kind is w.ErrorKind.JSONDecodingError


def test_py_and_reduce(flow):
    a, b = w.py(upper_lower, "Bla Bla")
    both = w.reduce(lambda *xs: "".join(xs), a, b, "|wat", out=w.Encoding.json)
    assert done(both) == "BLA BLAbla bla|wat"


def test_too_few_outputs(flow):
    a, b = w.py(lambda x: (x,), 1, out=[w.Encoding.json] * 2)
    w.execute(a)
    assert w.take(a) == 1
    assert w.take(b, strict=False).kind is w.ErrorKind.MissingOutput


def test_unknown_and_waiting(flow):
    assert w.take(w.Artefact("0" * 40, "root", w.Encoding.json), strict=False).kind is w.ErrorKind.NotFound
    a = w.morph(lambda x: x, 1)
    assert w.take(a, strict=False).kind is w.ErrorKind.NotFound
    with pytest.raises(w.UnwrapError):
        w.take(a)
    with pytest.raises(TimeoutError):
        w.wait_for(a, 0.01)
    w.execute(a)
    w.wait_for(a, 0.01)


def test_errors_keep_their_source(flow):
    bad = w.shell("true", out=["file"]).out["file"]
    strict = w.morph(lambda x: x, bad, name="strict")
    lax = w.morph(lambda r: b"bla bla" if isinstance(r, w.Error) else r, bad, strict=False, name="lax")
    w.execute(strict, lax)
    assert w.take(strict, strict=False) == w.take(bad, strict=False)
    assert w.take(strict, strict=False).source == bad.parent
    assert w.take(lax) == b"bla bla"


def test_first_of_several_errors(flow):
    a, b = (w.shell("true", f"echo {i}", out=[f"f{i}"]).out[f"f{i}"] for i in range(2))
    assert done(w.reduce(lambda x, y: x, a, b), strict=False).source == a.parent


def test_shell(flow):
    ran = w.shell("cat file1 file2", "exit 3", "echo $VARIABLE", inp={"file1": b"BLA", "file2": b" bla"}, env={"VARIABLE": "x"})
    w.execute(ran)
    assert [w.take(s) for s in ran.stdouts] == [b"BLA bla", b"", b"x\n"]
    assert [w.take(s) for s in ran.returncodes] == [0, 3, 0]
    with pytest.raises(AttributeError):
        ran.stdout
    with pytest.raises(TypeError):
        w.shell(3)


def test_shell_folders_and_missing_files(flow):
    ran = w.shell("cp in/a out/b", inp={"in/a": b"x"}, out=["out/b", "c"])
    w.execute(ran)
    assert w.take(ran.out["out/b"]) == b"x"
    assert w.take(ran.out["c"], strict=False).kind is w.ErrorKind.MissingOutput


def test_timeout(flow):
    slow = w.morph(lambda x: time.sleep(5), 1, opt=w.options(timeout=0.2), out=w.Encoding.json)
    assert done(slow, strict=False).kind is w.ErrorKind.JobTimedOut
    assert done(w.shell("sleep 5", opt=w.options(timeout=0.2)).stdout, strict=False).kind is w.ErrorKind.JobTimedOut


def test_make_checks_inputs(flow):
    f = Function(How.python, "f", {"a": w.Encoding.json}, {"out": w.Encoding.json}, lambda v: v)
    with pytest.raises(AttributeError):
        flow.make(f, {})
    with pytest.raises(AttributeError):
        flow.make(f, {"a": w.put(1), "b": w.put(1)})
    with pytest.raises(TypeError):
        flow.make(f, {"a": w.put(b"1")})


def test_cache_reset_and_evaluate(flow, tmp_path):
    def count(x: int) -> int:
        (tmp_path / f"run-{time.time_ns()}").touch()
        return x + 1

    def calls():
        return len(list(tmp_path.iterdir()))

    a = w.morph(count, 1)
    b = w.morph(lambda x: x * 2, a, name="double")
    for _ in range(2):
        w.execute(b)
    assert (w.take(b), calls()) == (4, 1)
    assert flow.run_wave([a.parent]) == {a.parent: RunStatus.using_cached}
    w.reset(a)
    assert flow.status(b.hash) is ArtefactStatus.no_data
    w.execute(b)
    assert calls() == 2
    with pytest.raises(AttributeError):
        w.reset(w.put(1))
    w.reset(b)
    again = w.morph(lambda x: x * 2, a, name="double", opt=w.options(evaluate=False))
    with pytest.raises(RuntimeError):
        w.execute(again)


def test_only_what_is_needed_runs(flow):
    a, b = w.morph(lambda x: x, 1, name="a"), w.morph(lambda x: x, 1, name="b")
    w.execute(a)
    assert flow.status(b.hash) is ArtefactStatus.no_data


def test_two_functions_of_one_name(flow):
    assert done(w.morph(lambda x: x + 1, 1)) == 2
    assert done(w.morph(lambda x: x * 10, 2)) == 20


def test_split_apply_combine(flow):
    out = w.sac(lambda x: x.split(" "), lambda p: w.morph(lambda x: 4 * len(x), p, out=w.Encoding.json), lambda ps: w.reduce(lambda *x: sum(x), *ps, out=w.Encoding.json), "1 2 3 4 5", out=w.Encoding.json)
    after = w.morph(lambda x: x + 1, out, name="after")
    assert done(after) == 21
    assert w.take(out) == 20


def test_nested_and_failing_split(flow):
    def inner(p):
        return w.sac(lambda x: x.split(" "), lambda q: w.morph(lambda x: int(x), q, out=w.Encoding.json), lambda qs: w.reduce(lambda *x: sum(x), *qs, out=w.Encoding.json), p, out=w.Encoding.json)

    out = w.sac(lambda xs: xs, inner, lambda ps: w.reduce(lambda *x: list(x), *ps, out=w.Encoding.json), ["1 2", "3 4 7", "1"], out=w.Encoding.json)
    assert done(out) == [3, 14, 1]
    bad = w.sac(lambda x: 1 / 0, inner, lambda ps: ps[0], "1", out=w.Encoding.json)
    assert done(bad, strict=False).kind is w.ErrorKind.ExceptionRaised
    constant = w.sac(lambda x: [x], lambda p: p, lambda ps: ps[0], 7, out=w.Encoding.json)
    assert done(constant) == 7


def test_template(flow):
    assert done(w.template("{{a}}{{b}}{{c}}", {"a": 2, "b": " cool ", "c": b"4me"})) == b"2cool4me"
    assert done(w.template("", {})) == b""
    assert done(w.template("{{template}}", {"template": "x"})) == b"x"


def test_mustache():
    assert mustache.render("{{a}} {{{a}}} {{&a}}", {"a": '<"&>'}) == '&lt;&quot;&amp;&gt; <"&> <"&>'
    assert mustache.render("{{#l}}{{n}},{{/l}}{{^l}}none{{/l}}{{! no }}", {"l": [{"n": 1}, {"n": 2}]}) == "1,2,"
    assert mustache.render("{{^l}}none{{/l}}", {"l": []}) == "none"
    assert mustache.render("{{=<% %>=}}<% a.b %>", {"a": {"b": 1}}) == "1"
    assert mustache.render("a\n{{#x}}\nb\n{{/x}}\nc\n", {"x": True}) == "a\nb\nc\n"
    with pytest.raises(ValueError):
        mustache.render("{{#x}}", {})


def test_utils(flow):
    u = w.utils
    assert done(u.concat(b"bla", b" bla ", b"bla", join=b" ", strip=True)) == b"bla bla bla"
    assert done(u.truncate(b"\n".join(b"%d" % i for i in range(10)), 2, 3)) == b"2\n3\n4\n5\n6"
    bad = u.not_empty(b"")
    assert done(bad, strict=False).kind is w.ErrorKind.ExceptionRaised
    assert done(u.not_empty(b"x")) == b"x"
    assert done(u.concat(b"a", bad, join=b",", strict=False)) == b"a"
    parts = [w.morph(lambda x: 10.0 / x, float(x), name="div") for x in range(3, -1, -1)]
    barrier = u.execute_all(parts)
    assert w.take(barrier, strict=False).kind is w.ErrorKind.ExceptionRaised
    assert w.take(parts[0]) == 10.0 / 3
    assert u.match_results([1, w.Error(w.ErrorKind.NotFound)], str) == ["1"]
    assert u.match_results([1, w.Error(w.ErrorKind.NotFound)], str, lambda e: e.kind.value) == ["1", "NotFound"]


def test_parametric(flow):
    a, b = w.put(3), w.put(4)
    s = w.reduce(lambda x, y: x + y, a, b, out=w.Encoding.json)
    s2 = w.morph(lambda x: 3 * x, s)
    first = w.parametric.commit("sum", {"a": a, "b": b}, {"s": s2})
    out = w.parametric.recall("sum", {"a": 5, "b": 8})["s"]
    w.execute(s2, out)
    assert (w.take(s2), w.take(out)) == (21, 39)
    assert done(w.parametric.recall(first, {"a": 5})["s"]) == 27
    with pytest.raises(AttributeError):
        w.parametric.recall("sum", {"z": 1})
    with pytest.raises(TypeError):
        w.parametric.recall("sum", {"a": b"1"})
    c, d = w.put(30), w.put(40)
    t = w.morph(lambda x: 3 * x, w.reduce(lambda x, y: x + y, c, d, out=w.Encoding.json))
    assert w.parametric.commit("other", {"a": c, "b": d}, {"s": t}) == first


def test_nested_parametric(flow):
    a, b = w.put(3), w.put("fun")
    x = w.reduce(lambda n, t: n * t, a, b)
    y = w.morph(str.upper, x)
    w.parametric.commit("shout", {"a": a, "b": b}, {"y": y})
    assert done(w.parametric.recall("shout", {"a": 5})["y"]) == "FUN" * 5
    assert done(w.parametric.recall("shout", {"b": "lol", "a": 2})["y"]) == "LOL" * 2


def test_links(flow):
    a, b, c = w.put(1), w.morph(lambda x: x, 2, name="b"), w.morph(lambda x: x, 3, name="c")
    flow.link(b.hash, c.hash)
    flow.link(c.hash, a.hash)
    assert w.take(b) == 1
    with pytest.raises(TypeError):
        flow.link(b.hash, w.put(b"x").hash)
    with pytest.raises(ValueError):
        flow.link(c.hash, b.hash)


def test_inference():
    def blob() -> bytes: ...
    def none() -> None: ...
    def several() -> tuple[bytes, int]: ...
    def any_length() -> tuple[int, ...]: ...
    def silent(): ...

    assert infer.output_types(blob) == (w.Encoding.blob,)
    assert infer.output_types(none) == (w.Encoding.json,)
    assert infer.output_types(several) == (w.Encoding.blob, w.Encoding.json)
    for f in (any_length, silent):
        with pytest.raises(TypeError):
            infer.output_types(f)


def test_blocks_and_files(tmp_path):
    small = MemoryStore(block=8)
    small.put("data", "k", b"12345" * 100)
    assert len(small.tables["data"]["k"]) == 63
    assert small.get("data", "k") == b"12345" * 100
    store = FileStore(str(tmp_path))
    store.put("data", "abcdef", b"x")
    assert (tmp_path / "data/ab/cdef").read_bytes() == b"x"
    assert list(store.keys("data", "abc")) == ["abcdef"] and store.get("data", "zz") is None
    with pytest.raises(NotImplementedError):
        open_store("ftp://x")


def test_prefixes(flow):
    a = w.put(4)
    assert flow.find(a.hash[:6]) == [a]
    with pytest.raises(AttributeError):
        w.get("0" * 41)
    assert w.get("zz") == []


def test_cli_and_debug(tmp_path, capsys):
    url = str(tmp_path / "store")
    with w.Flow(url) as flow:
        ran = w.shell("cat a", inp={"a": b"hello"})
        up = w.morph(bytes.upper, ran.stdout, out=w.Encoding.blob)
        assert main(["--store", url, "execute", up.hash]) == 0
        assert main(["--store", url, "cat", up.hash[:8]]) == 0
        assert capsys.readouterr().out == "HELLO"
        assert main(["--store", url, "cat", "zzzz"]) == 2
        assert main(["--store", url, "graph", up.hash]) == 0
        picture = capsys.readouterr().out
        assert picture.startswith("digraph workflow {") and picture.count("{") == picture.count("}") and picture.count("subgraph") == 2
        assert main(["--store", url, "debug", ran.hash, "-o", str(tmp_path / "d")]) == 0
        assert (tmp_path / "d/input_files/a").read_bytes() == b"hello"
        assert (tmp_path / "d/stdout0").read_bytes() == b"hello"
        assert main(["--store", url, "reset", up.hash]) == 0
        assert main(["--store", url, "wait", "-t", "0", up.hash]) == 2
        drawn = draw.outline(flow, [up.hash])
        assert len(drawn.steps) == 2 and (ran.stdout.hash, up.parent, "in0") in drawn.reads
        given = [v for v in drawn.values.values() if v.owner is None]
        assert [v.text for v in given] == ["a"] and given[0].id[:6] in draw.to_dot(drawn) and given[0].id[:6] not in draw.to_dot(drawn, given=False)
        assert draw._short('f<x>&"') == "f&lt;x&gt;&amp;&quot;"


def test_a_hundred_roots(flow):
    parts = []
    for i in range(100):
        parts.append(w.shell("cat f", inp={"f": w.morph(bytes.upper, b"bla%d" % i, out=w.Encoding.blob)}).stdout)
    out = w.utils.concat(*parts, join=b",")
    waves = list(flow.waves(flow.ancestors(out.parent) | {out.parent}))
    assert [len(x) for x in waves] == [100, 100, 1]


def test_run_names_what_was_killed(flow):
    def die(values):
        import os
        import signal

        os.kill(os.getpid(), signal.SIGTERM)
        time.sleep(1)

    f = Function(How.python, "die", {}, {"out": w.Encoding.json}, die)
    assert running.run("op", f, {})["out"].kind is w.ErrorKind.KilledBySignal


def test_on_spark(spark, tmp_path):
    url = f"file://{tmp_path}/store"
    with w.Flow(url, spark) as flow:
        parts = [w.morph(lambda x: x * x, i, name="square", out=w.Encoding.json) for i in range(6)]
        total = w.reduce(lambda *x: sum(x), *parts, out=w.Encoding.json, name="total")
        bad = w.morph(lambda x: 1 / x, 0, name="bad", out=w.Encoding.json)
        w.execute(total, bad)
        assert w.take(total) == 55
        assert w.take(bad, strict=False).kind is w.ErrorKind.ExceptionRaised
    with w.Flow(url) as flow:  # a later session finds it computed
        assert flow.run_wave([total.parent]) == {total.parent: RunStatus.using_cached}


def test_a_slow_step_holds_nothing_else(spark, tmp_path):
    """What waits for quick steps runs while a slow one of the same job goes on."""
    with w.Flow(f"file://{tmp_path}/store", spark) as flow:
        slow = w.shell("sleep 8; date +%s.%N")
        quick = w.shell("echo a")
        after = w.shell("cat f; date +%s.%N", inp={"f": quick.stdout})
        flow.execute(slow.op.hash, after.op.hash)
        assert float(w.take(after.stdout).split()[1]) < float(w.take(slow.stdout))
        assert not list(flow.store.keys("claims"))


def test_two_drivers_run_a_step_once(tmp_path):
    """Two flows over one store; the step counts its runs in a file."""
    import threading

    runs = tmp_path / "runs"
    url = str(tmp_path / "store")
    flows = [w.Flow(url), w.Flow(url)]
    steps = []
    for flow in flows:
        with flow:
            steps.append(w.shell(f"echo x >> {runs}; sleep 1; echo done"))
    threads = [threading.Thread(target=flow.execute, args=(step.op.hash,)) for flow, step in zip(flows, steps)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert runs.read_text() == "x\n"
    assert w.take(steps[1].stdout, connection=flows[1]) == b"done\n"


def test_claims_of_gone_drivers_end(tmp_path, monkeypatch):
    import weftline.flow as module

    flow, other = w.Flow(str(tmp_path / "s")), w.Flow(str(tmp_path / "s"))
    assert flow._claim("a" * 40) and flow._claim("a" * 40) and not other._claim("a" * 40)
    flow.forget_runs()
    assert other._claim("a" * 40)
    monkeypatch.setattr(module, "LEASE", -1.0)
    assert flow._claim("b" * 40) and other._claim("b" * 40)


def test_failures_are_logged(caplog):
    with w.Flow(), caplog.at_level("INFO", logger="weftline"):
        bad = w.morph(lambda x: 1 / x, 0, name="bad", out=w.Encoding.json)
        w.execute(bad)
    assert "runs here: bad" in caplog.text and "ExceptionRaised" in caplog.text
