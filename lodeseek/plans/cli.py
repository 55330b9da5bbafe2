"""The command line: python -m lodeseek.plans.cli <command> …"""

from __future__ import annotations

import sys
from collections.abc import Sequence

from pyspark.sql import SparkSession

from ..sources.collections import Registry
from ..sources.config import load_config
from . import ingest, tools
from .search import Searcher
from .store import Store

HELP = """Usage: lodeseek <command> [options]

  init <name> <path> [--update-cmd <cmd>]   register a collection for a folder
  index <name> [--rebuild]                  scan, chunk and store it
  embed <name> [--rebuild]                  embed chunks that have no vector
  update <name>                             store what has changed
  search <name> <query>                     full-text search
  query <name> <query>                      hybrid search
  get <name> <file>                         a file and its chunks
  status <name>                             counts
  list                                      all collections
  set-update-cmd <name> <cmd>               command that runs before updates
  copy <source> <name> <path>               copy a collection
  import <name> <store> <path>              copy a store into a new collection
  export <name> <path>                      copy a collection's store out
  config [<name>]                           the settings in force
  mcp [--collection <name>]                 serve tools on standard input and output
  help                                      this text

  --limit <n> (10)  --no-expand  --no-rerank  --benchmark"""


def parse_arguments(args: Sequence[str]) -> tuple[str, list[str], dict[str, str | bool]]:
    """Command, positional arguments, flags. A flag takes the next word as its value unless that is a flag or it begins with no-."""
    if not args or list(args) == ["--help"]:
        return "help", [], {}
    command = "help" if args[0].startswith("--") else args[0]
    rest = list(args if args[0].startswith("--") else args[1:])
    positional: list[str] = []
    flags: dict[str, str | bool] = {}
    while rest:
        word = rest.pop(0)
        if not word.startswith("--"):
            positional.append(word)
            continue
        key, equals, value = word[2:].partition("=")
        if equals:
            flags[key] = value
        elif rest and not rest[0].startswith("--") and not key.startswith("no-"):
            flags[key] = rest.pop(0)
        else:
            flags[key] = True
    return command, positional, flags


def printed(results: list, mode: str) -> str:
    if not results:
        return "No results found."
    out = [f"{len(results)} result(s) [{mode}]:"]
    for i, r in enumerate(results, 1):
        at = f":{r['start_line']}" if r["start_line"] is not None else ""
        name = f" ({r['name']})" if r["name"] else ""
        kind = f" [{r['chunk_type']}]" if r["chunk_type"] else ""
        scores = ", ".join(f"{k}={v:.4f}" for k, v in r["scores"].asDict().items() if v is not None)
        lines = r["content"].split("\n")
        more = f"\n    ... ({len(lines) - 8} more lines)" if len(lines) > 8 else ""
        out.append(f"#{i} {r['file_path']}{at}{name}{kind} score {r['score']:.4f}\n    scores: {scores}\n" + "\n".join(lines[:8]) + more)
    return "\n\n".join(out)


class Commands:
    def __init__(self, spark: SparkSession, registry: Registry):
        self.spark, self.registry = spark, registry

    def store(self, name: str) -> Store:
        return Store(self.spark, f"file://{self.registry.get(name).store_path}")

    def searcher(self, name: str) -> Searcher:
        config, embedder, model = load_config(self.registry.home, name), None, None
        try:
            embedder = ingest.embedder_factory(config)()
        except ValueError:
            pass
        try:
            model = ingest.language_model(config)
        except ValueError:
            pass
        return Searcher(self.store(name), embedder, model)

    def run(self, args: Sequence[str]) -> str:
        command, words, flags = parse_arguments(args)
        if flags.get("help") or command == "help":
            return HELP
        method = getattr(self, f"do_{command.replace('-', '_')}", None)
        if method is None:
            raise ValueError(f"unknown command: {command}\n{HELP}")
        try:
            return method(*words, flags=flags)
        except TypeError as e:
            if f"do_{command.replace('-', '_')}()" in str(e):
                raise ValueError(f"wrong arguments\n{HELP}") from None
            raise

    def do_init(self, name: str, path: str, flags: dict) -> str:
        self.registry.register(name, path, flags.get("update-cmd") or None)
        return f"Collection {name} for {path}"

    def do_index(self, name: str, flags: dict) -> str:
        r = ingest.index(self.store(name), self.registry.get(name).source_path, load_config(self.registry.home, name), bool(flags.get("rebuild")))
        return f"{r.new} new, {r.changed} changed, {r.unchanged} unchanged files"

    def do_embed(self, name: str, flags: dict) -> str:
        n = ingest.embed(self.store(name), ingest.embedder_factory(load_config(self.registry.home, name)), bool(flags.get("rebuild")))
        return f"{n} chunks embedded"

    def do_update(self, name: str, flags: dict) -> str:
        c, config = self.registry.get(name), load_config(self.registry.home, name)
        store = self.store(name)
        r = ingest.update(store, c.source_path, config, c.update_command)
        out = f"{r.new} new, {r.changed} changed, {r.unchanged} unchanged, {r.deactivated} removed files; {r.deleted_chunks} chunks and {r.deleted_vectors} vectors deleted"
        try:
            return out + f"; {ingest.embed(store, ingest.embedder_factory(config))} chunks embedded"
        except ValueError:
            return out

    def do_search(self, name: str, *query: str, flags: dict) -> str:
        return self._search(name, " ".join(query), "bm25", flags, False, False)

    def do_query(self, name: str, *query: str, flags: dict) -> str:
        return self._search(name, " ".join(query), "hybrid", flags, not flags.get("no-expand"), not flags.get("no-rerank"))

    def _search(self, name: str, query: str, mode: str, flags: dict, expand: bool, rerank: bool) -> str:
        s = Searcher(self.store(name)) if mode == "bm25" else self.searcher(name)
        got = s.search(query, mode if s.embedder or mode == "bm25" else "bm25", int(flags.get("limit") or 10), expand, rerank, benchmark=bool(flags.get("benchmark")))
        out = printed(got.results.collect(), mode)  # at most ``limit`` rows
        return out + "".join(f"\n{k}: {v:.0f} ms" for k, v in (got.timing or {}).items())

    def do_get(self, name: str, path: str, flags: dict) -> str:
        return tools.Tools(self.store(name), lambda: self.searcher(name), name).get_file(path)

    def do_status(self, name: str, flags: dict) -> str:
        return tools.Tools(self.store(name), lambda: self.searcher(name), name).status()

    def do_list(self, flags: dict) -> str:
        return "\n".join(f"{n}\t{self.registry.get(n).source_path}" for n in self.registry.names()) or "No collections."

    def do_set_update_cmd(self, name: str, *command: str, flags: dict) -> str:
        self.registry.update(name, update_command=" ".join(command) or None)
        return f"Update command of {name} set"

    def do_copy(self, source: str, name: str, path: str, flags: dict) -> str:
        self.registry.copy(source, name, path)
        return f"{source} copied to {name}"

    def do_import(self, name: str, store: str, path: str, flags: dict) -> str:
        self.registry.import_store(name, store, path)
        return f"{store} imported as {name}"

    def do_export(self, name: str, to: str, flags: dict) -> str:
        self.registry.export_store(name, to)
        return f"{name} exported to {to}"

    def do_config(self, name: str | None = None, *, flags: dict) -> str:
        import json

        return json.dumps(load_config(self.registry.home, name).as_dict(), indent=2)

    def do_mcp(self, *words: str, flags: dict) -> str:
        name = str(flags.get("collection") or (words or self.registry.names() or [""])[0])
        tools.serve(tools.Tools(self.store(name), lambda: self.searcher(name), name))
        return ""


def main(args: Sequence[str] | None = None) -> int:
    spark = SparkSession.builder.appName("lodeseek").getOrCreate()
    try:
        print(Commands(spark, Registry()).run(sys.argv[1:] if args is None else args))
        return 0
    except ValueError as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
