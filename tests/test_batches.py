import gc

import pyarrow as pa

from codescope.functions import batches
from codescope.operators import dockerfile, python_symbols, script_symbols


def test_slices_hold_few_files(monkeypatch):
    monkeypatch.setattr(batches, "SLICE_ROWS", 3)
    monkeypatch.setattr(batches, "SLICE_BYTES", 10)
    texts = pa.array(["a", "b", None, "c", "d" * 30, "", "e" * 6, "f" * 6, None])
    met = []

    def convert(part, twin):
        assert part.equals(twin)
        met.append(part.to_pylist())
        return part

    assert batches.by_slices(convert, texts, texts).equals(texts)
    assert met == [["a", "b", None], ["c"], ["d" * 30], ["", "e" * 6], ["f" * 6, None]]
    assert batches.by_slices(convert, texts[:0], texts[:0]).to_pylist() == []


def test_parsers_read_slice_by_slice(spark, monkeypatch):
    sources = {
        script_symbols: (script_symbols._scan, "const a = 1;\n"),
        dockerfile: (dockerfile._instructions, "FROM a\n# b\nRUN c  \n"),
        python_symbols: (python_symbols._parser(False, False).func, "import a\n\ndef f(): pass\n"),
    }
    for module, (parse, source) in sources.items():
        texts = pa.array([source, None, "", source] * 5)
        whole = parse(texts)
        calls = []

        def by_slices(convert, *arrays, calls=calls):
            return batches.by_slices(lambda *parts: calls.append(len(parts[0])) or convert(*parts), *arrays)

        with monkeypatch.context() as m:
            m.setattr(module, "by_slices", by_slices)
            m.setattr(batches, "SLICE_ROWS", 4)
            assert parse(texts).equals(whole)
        assert calls == [4] * 5


def test_files_of_other_kinds_are_not_sliced(monkeypatch):
    def refuses(*arrays):
        raise AssertionError("nothing to parse")

    nulls = pa.nulls(5, pa.string())
    parsers = {script_symbols: script_symbols._scan, dockerfile: dockerfile._instructions,
               python_symbols: python_symbols._parser(True, False).func}
    for module, parse in parsers.items():
        whole = parse(nulls)
        monkeypatch.setattr(module, "by_slices", refuses)
        assert parse(nulls).equals(whole) and whole.null_count == 5


def test_cycles_are_not_searched_for_while_files_are_parsed():
    seen = []

    def watched(texts):
        seen.append(gc.isenabled())
        return texts

    assert gc.isenabled()
    batches.by_slices(watched, pa.array(["a"] * 2_500))
    assert seen == [False] * 3 and gc.isenabled()
