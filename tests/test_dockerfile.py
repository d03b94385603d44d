import pytest

from codescope.operators import dockerfile
from codescope.plans import lookup, views

TEXT = """\
# syntax=docker/dockerfile:1
ARG VERSION=1

FROM --platform=linux base:1 AS build
  run  make \\
    && make install
FROM base:2 as run
COPY --from=build /a /b
env A=1
FROM base:3
CMD
FROM base:4 AS build
USER app
"""


@pytest.fixture
def files(files_of):
    return files_of({"Dockerfile": TEXT, "a/Dockerfile.dev": "", "b.dockerfile": "RUN x\x0cUSER y ENV Z", "c/Dockerfile": "FROM\n"})


def shown(view, files):
    return {r.path: r.view for r in view(files).collect()}


def test_structure(files):
    got = shown(views.structure, files)
    assert got["Dockerfile"] == (
        "stages: build, run, stage2, build\ninstructions: && ARG CMD COPY ENV FROM RUN USER"
    )
    assert got["a/Dockerfile.dev"] == "instructions: "
    assert got["b.dockerfile"] == "instructions: ENV RUN USER"


def test_skeleton(files):
    got = shown(views.skeleton, files)
    assert got["Dockerfile"] == (
        "ARG VERSION=1\nFROM --platform=linux base:1 AS build\nFROM base:2 as run\nENV A=1\nFROM base:3\nCMD \n"
        "FROM base:4 AS build\nUSER app"
    )
    assert got["a/Dockerfile.dev"] == "(empty)"


def test_base_images(files):
    got = shown(views.imports, files)
    assert got["Dockerfile"].split("\n") == [
        "FROM --platform=linux base:1 AS build", "FROM base:2 as run", "FROM base:3", "FROM base:4 AS build",
    ]
    assert got["a/Dockerfile.dev"] == "(no FROM instructions)"


def test_stage_rows(files):
    rows = dockerfile.docker_stages(files.where("path in ('Dockerfile', 'c/Dockerfile')")).collect()
    assert {(r.path, r.stage_no): (r.stage_name, r.base) for r in rows} == {
        ("Dockerfile", 0): ("build", "--platform=linux"), ("Dockerfile", 1): ("run", "base:2"),
        ("Dockerfile", 2): ("stage2", "base:3"), ("Dockerfile", 3): ("build", "base:4"),
        ("c/Dockerfile", 0): ("stage0", None),
    }


def test_continuations_can_be_joined(files):
    rows = dockerfile.docker_instructions(files.where("path = 'Dockerfile'"), join_continuations=True)
    assert [r.args for r in rows.where("inst = 'RUN'").collect()] == ["make      && make install"]


def test_bodies(spark, files, join_way):
    requests = [(1, "run"), (2, "build"), (3, "from"), (4, "stage2"), (5, "nope"), (6, "RUN")]
    frame = spark.createDataFrame([(i, "Dockerfile", n) for i, n in requests], "req_id long, path string, name string")
    rows = {r.req_id: r for r in lookup.symbol_body(files, frame).collect()}
    assert rows[1].result == "RUN make \\"  # a type wins over the stage of that name
    assert rows[6].result == "RUN make \\"
    assert rows[2].result == "FROM --platform=linux base:1 AS build\nRUN make \\\n&& make install"
    assert rows[3].result.count("\n") == 3
    assert rows[4].result == "FROM base:3\nCMD "
    assert rows[5].message == "Stage 'nope' not found. Stages: build, run, stage2, build"
    none = spark.createDataFrame([(1, "a/Dockerfile.dev", "x")], "req_id long, path string, name string")
    assert lookup.symbol_body(files, none).first().message == "Stage 'x' not found. Stages: none"


def test_instructions_are_cut_in_batches(spark):
    """Blanks and line ends of all kinds; texts are not trimmed line by line in row expressions, which is slow."""
    blanks = " \t\x0b\x0c\x1c\x1f\x85\xa0\u2003\u2028\u3000\n\r"
    texts = [f"FROM{a}x{b}y{a}{b}# z{b}#w{a}\u00df\u00e9{b}{a}RUN{b}a{a}b" for a in blanks for b in blanks] + ["", None]
    files = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "path string, text string")
    cut = dockerfile.docker_instructions(files)
    assert "trim(" not in cut._jdf.queryExecution().optimizedPlan().toString()
    wanted = []
    for i, text in enumerate(texts):
        stage, ord_ = None, 0
        for n, line in enumerate((text or "").splitlines(), 1):
            line = line.strip()
            if line and not line.startswith("#"):
                first = line.split()[0]
                stage = stage if first.upper() != "FROM" else 0 if stage is None else stage + 1
                wanted.append((str(i), ord_, n, first.upper(), line[len(first):].strip(), stage))
                ord_ += 1
    assert sorted(map(tuple, cut.collect()), key=lambda r: (int(r[0]), r[1])) == wanted
