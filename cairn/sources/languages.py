"""Languages by file name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_EXTENSIONS = {
    "bash": "sh bash zsh", "c": "c h", "clojure": "clj cljs cljc edn", "cpp": "cpp cc cxx hpp hh hxx", "csharp": "cs", "css": "css",
    "dart": "dart", "elixir": "ex exs", "erlang": "erl hrl", "go": "go", "groovy": "groovy gradle", "haskell": "hs", "html": "html htm",
    "java": "java", "javascript": "js jsx mjs cjs", "json": "json", "julia": "jl", "kotlin": "kt kts", "lua": "lua", "markdown": "md mdx markdown",
    "matlab": "m", "objc": "mm", "ocaml": "ml mli", "perl": "pl pm", "php": "php", "powershell": "ps1 psm1", "python": "py pyw pyi", "r": "r R",
    "ruby": "rb", "rust": "rs", "scala": "scala sc", "scss": "scss", "solidity": "sol", "sql": "sql", "svelte": "svelte", "swift": "swift",
    "toml": "toml", "typescript": "ts tsx mts cts", "vue": "vue", "xml": "xml xsd xsl xslt", "yaml": "yaml yml", "zig": "zig",
}
OF_EXTENSION = {e: language for language, of in _EXTENSIONS.items() for e in of.split()}
LANGUAGES = tuple(_EXTENSIONS)
ALIASES = {"tsx": "typescript", "jsx": "javascript", "sh": "bash", "shellscript": "bash", "ocaml_interface": "ocaml"}


def detect(path: str) -> str | None:
    name = path.rsplit("/", 1)[-1]
    ext = name.rpartition(".")[2] if "." in name else ""
    return OF_EXTENSION.get(ext) or OF_EXTENSION.get(ext.lower())


def language_of(path: Column | str) -> Column:
    """The same as an expression: a map literal, so that no join is needed."""
    c = F.col(path) if isinstance(path, str) else path
    ext = F.regexp_extract(c, r"\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for kv in OF_EXTENSION.items() for x in kv])
    return F.coalesce(F.try_element_at(table, ext), F.try_element_at(table, F.lower(ext)))
