import pytest

from graphloom.__main__ import parser, run


@pytest.fixture(scope="module")
def k5(tmp_path_factory):
    path = tmp_path_factory.mktemp("g") / "k5.txt"
    path.write_text("# complete\n" + "".join(f"{a} {b}\n" for b in range(5) for a in range(b)))
    return str(path)


@pytest.mark.parametrize(("args", "number"), [(["match", "-q", "0"], 10), (["match", "-q", "25"], 1), (["cliques"], 1), (["cores"], 1), (["quasi", "--ratio", "0.9", "--min-size", "3"], 1), (["fennel", "-k", "1"], 1), (["kmeans", "-k", "1", "-i", "2"], 1)])
def test_numbers(spark, k5, args, number):
    assert run(spark, parser().parse_args([args[0], k5, *args[1:]])) == number


@pytest.mark.parametrize("to", ["bin", "peregrine", "pangolin", "gsi", "adjacency", "labelled", "parquet"])
def test_convert(spark, k5, to, tmp_path):
    out = str(tmp_path / "x")
    assert run(spark, parser().parse_args(["convert", k5, "--to", to, "--out", out])) == 10
    kind = {"bin": "bin", "labelled": "graph", "adjacency": "adj", "peregrine": "txt", "pangolin": "txt"}.get(to)
    if kind:
        assert run(spark, parser().parse_args(["match", out, "--kind", kind, "-q", "24"])) == 5


def test_sets_and_kernels(spark, k5, tmp_path):
    (tmp_path / "sets").write_text("2 1 2\n3 1 2 3\n1 9\n")
    out = str(tmp_path / "out")
    assert run(spark, parser().parse_args(["maximal", str(tmp_path / "sets"), "--out", out])) == 2
    assert sorted(r.value for r in spark.read.text(out).collect()) == ["1 9", "3 1 2 3"]
    assert run(spark, parser().parse_args(["kernels", k5, "--kernel-file", str(tmp_path / "sets"), "--first", "1", "--min-size", "3"])) == 1
