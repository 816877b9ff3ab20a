"""Table functions for SQL: subtitle cues from the lines of a file, or from a whole text beside other columns.

srt_cues(TABLE(lines) PARTITION BY file ORDER BY line_no, 'line', 'file') reads the lines of one file after another, a few numbers of state at a time: Spark deals and
sorts the partitions. A row may hold a line, or an array of lines that follow one another: what a row costs is then shared by many. srt_text_cues(value) takes one text, for a lateral join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

_TIMES = re.compile(r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)")
_WHO = re.compile(r"\[?(SPEAKER_\d+)\]?:\s*")
_CUE = T.StructType([T.StructField("cue_idx", T.IntegerType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType())])


class CueReader:
    """Cues from lines as they come: a blank line ends a cue, number lines and <u> tags go; what is not a cue has no time line."""

    def __init__(self) -> None:
        self.count = 0
        self._clear()

    def _clear(self) -> None:
        self.times: tuple[float, float] | None = None
        self.words: list[str] = []
        self.any = False

    def line(self, line: str) -> tuple | None:
        """The cue that this line ends, if any."""
        line = line.strip()
        if not line:
            return self.end()
        self.any = True
        if self.times is None and (m := _TIMES.search(line)):
            h1, m1, s1, f1, h2, m2, s2, f2 = m.groups()
            self.times = int(h1) * 3600 + int(m1) * 60 + float(f"{s1}.{f1}"), int(h2) * 3600 + int(m2) * 60 + float(f"{s2}.{f2}")
        elif not line.isdigit():
            self.words.append(line)
        return None

    def end(self) -> tuple | None:
        if not self.any:
            return None
        number, self.count = self.count, self.count + 1
        text = re.sub(r"</?u>", "", " ".join(self.words)).strip()
        who = _WHO.match(text)
        cue = (number, *self.times, who and who[1], text[who.end() :] if who else text) if self.times else None
        self._clear()
        return cue


class SrtCues:
    """A cue for each block of a partition's lines, with the columns named in keys (comma-joined) in front. Lines that are null count as blank, as does a null array."""

    def __init__(self) -> None:
        self.reader = CueReader()
        self.key: tuple = ()

    @staticmethod
    def analyze(lines: AnalyzeArgument, line: AnalyzeArgument, keys: AnalyzeArgument) -> AnalyzeResult:
        if not lines.isTable or not line.isConstantExpression or not keys.isConstantExpression:
            raise ValueError("srt_cues takes TABLE(lines) and the names of its line and key columns")
        fields = {f.name: f for f in lines.dataType.fields}
        names = [k.strip() for k in keys.value.split(",") if k.strip()]
        if missing := [n for n in [line.value, *names] if n not in fields]:
            raise ValueError(f"srt_cues: no column {', '.join(missing)}")
        return AnalyzeResult(schema=T.StructType([*[fields[n] for n in names], *_CUE.fields]))

    def eval(self, row: Row, line: str, keys: str) -> Iterator[tuple]:
        self.key = tuple(row[k.strip()] for k in keys.split(",") if k.strip())
        lines = row[line]
        for one in lines if isinstance(lines, list) else (lines,):
            if cue := self.reader.line(one or ""):
                yield (*self.key, *cue)

    def terminate(self) -> Iterator[tuple]:
        if cue := self.reader.end():
            yield (*self.key, *cue)


@udtf(returnType=_CUE)
class SrtTextCues:
    """The cues of one text; none of a null one."""

    def eval(self, value: str) -> Iterator[tuple]:
        reader = CueReader()
        for line in (value or "").split("\n"):
            if cue := reader.line(line):
                yield cue
        if cue := reader.end():
            yield cue


def register_table_functions(spark: SparkSession) -> None:
    """srt_cues and srt_text_cues, for the SQL of this session."""
    spark.udtf.register("srt_cues", udtf(SrtCues))
    spark.udtf.register("srt_text_cues", SrtTextCues)
