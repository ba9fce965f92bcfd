"""The engine as a user meets it: put files in, ask, export."""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom import catalog as cat
from gridloom.export.match import prepared
from gridloom.export.sinks import EXPORTERS, Written, first_rows
from gridloom.operators.cells import tables as cell_tables
from gridloom.operators.cells import unmerge
from gridloom.plans import guard, router
from gridloom.scratch import materialize
from gridloom.session import ship
from gridloom.sources import documents, files


#: Phrases that ask for the columns of the last export.
AS_BEFORE = re.compile(r"\bsame (columns?|fields?|layout|format)\b|\bas\b.{0,20}\b(before|last time|usual|earlier)\b|\b(i|we) (asked|wanted|agreed|specified)\b")
#: What stands between the steps of a prompt.
STEPS = re.compile(r"(?i)\band then\b|\bafter that\b|\bafterwards\b")
#: Headings, characters of text and rows that an answer shows, and rows that a query must give within the deadline.
HEADINGS, CHARACTERS, SAMPLE, PREVIEW = 60, 2000, 3, 1000


@dataclass
class Answer:
    intent: str
    text: str = ""
    table: DataFrame | None = None
    sql: str | None = None
    written: Written | None = None


@dataclass
class Engine:
    """``write_sql(prompt, schema, error)`` is a model behind a function; without one, data questions need ``sql``."""

    spark: SparkSession
    output: str = "exports"
    write_sql: Callable[[str, str, str | None], str] | None = None
    deadline: float = 30.0  # seconds in which a query must give its first rows
    write_deadline: float = 600.0  # seconds in which an export must be written
    catalog: cat.Catalog = field(init=False)
    history: dict[str, list[dict]] = field(default_factory=dict)
    outlines: dict[str, DataFrame] = field(default_factory=dict)  # headings of the files that have any
    specs: dict[str, tuple[list[str] | None, dict | None]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)
        self.catalog = cat.Catalog(self.spark)

    def ingest(self, path: str, file_id: str, name: str | None = None) -> int:
        """Loads a file's tables under ``file_id``; the file's own name is kept for prompts. Gives their number.

        A file that comes again with the same content is left as it is; with another, all that was kept of it goes.
        """
        name = name or path.rsplit("/", 1)[-1]
        key = files.state_of(self.spark, path)
        if self.catalog.holds(file_id, key):
            return len(self.catalog.of([file_id]))
        self.outlines.pop(file_id, None)
        self.catalog.add_file(file_id, name, files.kind_of(name), key)
        self.spark.catalog.refreshByPath(path)
        extension = name.rpartition(".")[2].lower()
        if extension == "csv":
            self.catalog.add_table(file_id, "data", files.read_csv(self.spark, path), 1)
        elif extension == "xlsx":
            cells, merges = files.read_workbook(self.spark, path)
            order = {r.sheet: r.at for r in cells.groupBy("sheet").agg(F.min("sheet_no").alias("at")).collect()}
            self._add_cells(file_id, cells, merges, lambda label: order.get(label, order.get(label.rpartition(" (block")[0])))
        elif extension in ("html", "htm"):
            page = files.read_text(self.spark, path)
            html = page.select(F.lit(1).alias("page_id"), F.col("text").alias("html"))
            self.outlines[file_id] = files.headings(html)
            self.catalog.add_table(file_id, "text", page.select(F.lit(1).alias("page"), files.visible_text(F.col("text")).alias("text"), "content_key"), 1)
            self._add_cells(file_id, *files.html_tables(html), lambda _: 1)
        elif extension in documents.PARSERS:
            rows = materialize(documents.read_documents(self.spark, path), "document")
            self.outlines[file_id] = documents.headings_of(rows)
            self.catalog.add_table(file_id, "text", documents.page_texts(rows))
            cells, merges = documents.tables_of(rows)
            pages = {r.sheet: r.at for r in cells.groupBy("sheet").agg(F.min("page").alias("at")).collect()}
            self._add_cells(file_id, cells, merges, lambda label: pages.get(label, pages.get(label.rpartition(" (block")[0])))
        elif extension in ("txt", "md"):
            self.catalog.add_table(file_id, "text", files.pages_of(files.read_text(self.spark, path)))
        else:
            raise ValueError(f"no reader for .{extension} files is installed")
        return len(self.catalog.of([file_id]))

    def _add_cells(self, file_id: str, cells: DataFrame, merges: DataFrame, page_of: Callable[[str], int | None]) -> None:
        """The tables among the cells, which are cleaned once and written, as each table is read from them."""
        found = materialize(cell_tables(unmerge(cells.select("sheet", "row", "col", "value"), merges)), "cells")
        for label, df in files.typed_tables(found).items():
            self.catalog.add_table(file_id, label, df, page_of(label))

    def plan(self, prompt: str, file_id: str | None = None) -> dict:
        """Intent, scope and clauses of a prompt."""
        one = self.spark.createDataFrame([(prompt,)], "prompt string")
        if self.catalog.files:
            one = cat.scope(one, self.catalog.file_rows().select("file_id", "name", "pos"))
        else:
            one = one.withColumn("scope", F.array().cast("array<string>"))
        known = F.array(*[F.lit(f) for f in self.catalog.files]).cast("array<string>")
        targets = one.select(cat.target_files(F.lit(file_id), F.col("scope"), known).alias("files")).first()["files"]
        tabular = any(self.catalog.files[f]["kind"] == "tabular" for f in targets if f in self.catalog.files)
        return router.routed(one, "prompt", tabular).first().asDict(recursive=True) | {"files": targets}

    def query(self, sql: str, file_ids: list[str] | None = None) -> DataFrame:
        """A guarded, read-only query over the tables of the files (all by default), which must give its first rows within
        the deadline."""
        views = self.catalog.register(file_ids or list(self.catalog.files))
        df = guard.run(self.spark, sql, list(views))
        guard.rows_within(df.limit(PREVIEW), self.deadline)
        return df

    def ask(self, prompt: str, session: str = "default", file_id: str | None = None, sql: str | None = None) -> Answer:
        """Answers a prompt. One of several steps (``and then``) is answered step by step, each on what the last one gave."""
        began, plan = time.time(), self.plan(prompt, file_id)
        steps = [s.strip(" ,.") for s in STEPS.split(prompt)]
        several = plan["intent"] == "complex" or (plan["sink"] is not None and sum(map(bool, steps)) > 1)
        answer = self._steps(steps, session, file_id, sql) if several else self._answer(prompt, session, plan, sql)
        self.history.setdefault(session, []).append({"prompt": prompt, "intent": answer.intent, "text": answer.text, "seconds": round(time.time() - began, 2)})
        return answer

    def _steps(self, steps: list[str], session: str, file_id: str | None, sql: str | None) -> Answer:
        """Each step has the intent of its own words; a step that only names a file writes what the step before gave."""
        done: list[Answer] = []
        for step in filter(None, steps):
            plan = self.plan(step, file_id)
            before = next((a.table for a in reversed(done) if a.table is not None), None)
            if plan["intent"] == "export" and before is not None:
                frames, verdict = prepared([cat.Table("", "previous", before)], plan["columns"], plan["rename"])
                written = self._write(frames, plan, "export")
                done.append(Answer("export", written.message if verdict is None or verdict.ok else f"{written.message} (unverified: {'; '.join(verdict.problems)})", before, written=written))
            else:
                done.append(self._answer(step, session, plan, sql if plan["intent"] == "data_query" else None))
        last = done[-1]
        return Answer("complex", "\n\n".join(a.text for a in done if a.text), next((a.table for a in reversed(done) if a.table is not None), None), next((a.sql for a in done if a.sql), None), last.written)

    def _answer(self, prompt: str, session: str, plan: dict, sql: str | None) -> Answer:
        intent, targets = plan["intent"], plan["files"]
        if intent == "chat_history":
            turns = self.history.get(session, [])[-6:]
            return Answer(intent, "\n\n".join(f"You: {t['prompt'][:300]}\nAnswer: {t['text'][:300]}" for t in turns) or "No earlier messages.")
        if intent == "list_files":
            rows = self.catalog.file_rows().orderBy("pos")
            return Answer(intent, "\n".join(f"{f['pos'] + 1}. {f['name']} ({f['kind']}, {f['file_id']})" for f in self.catalog.files.values()), rows)
        if intent == "list_columns":
            views = self.catalog.register(targets)
            samples = [f"{name}:\n" + "\n".join(str(tuple(r)) for r in first_rows(t.df, SAMPLE).collect()) for name, t in views.items()]
            return Answer(intent, "\n\n".join([self.catalog.schema_text(views), *samples]))
        if intent == "table_of_contents":
            found = [self.outlines[f] for f in targets if f in self.outlines]
            lines = [f"{'  ' * (r.level - 1)}{r.text}" for df in found for r in df.orderBy("place").limit(HEADINGS).collect()]
            return Answer(intent, "\n".join(lines) or "No headings are stored.")
        if intent in ("overview", "page_lookup"):
            texts = [t.df for t in self.catalog.of(targets) if "text" in t.df.columns]
            if intent == "page_lookup":
                texts = [df.where(F.col("page") == plan["page"]) for df in texts if "page" in df.columns]
            found = [r.text for df in texts for r in first_rows(df.select(F.substring("text", 1, CHARACTERS).alias("text")), 1).collect() if r.text]
            if intent == "page_lookup" and (tables := [t for t in self.catalog.of(targets, 2, 1, real=True, page=plan["page"]) if t.page != "text"]):
                found.append("Tables on this page: " + ", ".join(t.page for t in tables))
                return Answer(intent, "\n\n".join(found), tables[0].df)
            return Answer(intent, "\n\n".join(found) or "No text is stored for that.")
        if intent == "data_query":
            views = self.catalog.register(targets)
            schema, error = self.catalog.schema_text(views), None
            for _ in range(1 if sql or not self.write_sql else 3):
                text = sql or (self.write_sql(prompt, schema, error) if self.write_sql else None)
                if not text:
                    return Answer(intent, f"Tables to query:\n{schema}")
                try:
                    df = guard.run(self.spark, text, list(views))
                    guard.rows_within(df.limit(PREVIEW), self.deadline)  # finds errors at run time, and queries that never end
                except Exception as e:  # noqa: BLE001  the next attempt is told
                    error = str(e).splitlines()[0]
                    continue
                written = self._write([df], plan, "query") if plan["sink"] else None
                return Answer(intent, written.message if written else "", df, text, written)
            return Answer(intent, f"The query failed: {error}")
        if intent == "export":
            wanted, names = plan["columns"], plan["rename"]
            if not wanted and not names and AS_BEFORE.search(prompt.lower()):
                wanted, names = self.specs.get(session, (None, None))
            elif wanted or names:
                self.specs[session] = (wanted, names)
            frames, verdict = prepared(self.catalog.of(targets), wanted, names)
            written = self._write(frames, plan, "export")
            note = "" if verdict is None or verdict.ok else f" (unverified: {'; '.join(verdict.problems)})"
            return Answer(intent, written.message + note, written=written)
        return Answer(intent, "This needs a model, and none is connected.")

    def _write(self, frames: list[DataFrame], plan: dict, stub: str) -> Written:
        sink = plan["sink"] or "csv"
        ending = {"csv": "csv", "excel": "xlsx", "docx": "docx", "pptx": "pptx", "chart": "svg"}[sink]
        os.makedirs(self.output, exist_ok=True)
        name = os.path.basename(plan["filename"] or f"{stub}.{ending}")
        target = os.path.join(self.output, name)
        return guard.within(self.spark, self.write_deadline, lambda: EXPORTERS[sink](frames, target))
