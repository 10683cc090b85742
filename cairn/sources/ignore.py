"""What a scan leaves out: built-in rules, ignore files, patterns of the caller."""

from __future__ import annotations

import logging
import os
import re

log = logging.getLogger("cairn")

_FOLDERS = "__pycache__ build coverage dist node_modules out"
_ENDINGS = "7z backup bak csproj eot fsproj gif gz ico jpeg jpg lock map min.css min.js pdf png podspec props sln svg tar targets ttf vbproj woff woff2 zip"
_NAMES = """
AGENTS.md CLAUDE.md COPILOT.md Cargo.toml GEMINI.md Gemfile Package.swift Podfile angular.json biome.json biome.jsonc build.gradle
build.gradle.kts bun.lockb composer.json global.json go.mod go.sum go.work.sum ionic.config.json jsconfig.json lerna.json mypy.ini
nuget.config nx.json package-lock.json pnpm-lock.yaml pnpm-workspace.yaml pnpm-workspace.yml pom.xml pyproject.toml pyrightconfig.json
pytest.ini rush.json settings.gradle settings.gradle.kts setup.cfg tox.ini tsconfig.json turbo.json wrangler.json wrangler.jsonc wrangler.toml
cairn.json cairn.toml
"""
_TOOLS = {"js ts mjs cjs": "astro cypress docusaurus eleventy esbuild eslint lint-staged commitlint next nuxt playwright postcss prettier remix rollup stylelint svelte tailwind tsdown tsup vite vitest webpack", "js ts mjs cjs json": "babel jest", "json ts": "capacitor"}


def default_excludes() -> list[str]:
    """Hidden files, build output, lock files, media, minified code, manifests and the settings of common tools."""
    out = ["**/.*", "**/.*/**"]
    out += [f"**/{d}/**" for d in _FOLDERS.split()]
    out += [f"**/*.{e}" for e in _ENDINGS.split()]
    out += [f"**/{n}" for n in _NAMES.split()]
    for endings, tools in _TOOLS.items():
        out += [f"**/{t}.config.{{{','.join(endings.split())}}}" for t in tools.split()]
    return [*out, "**/gatsby-config.{js,ts,mjs,cjs}", "**/tsconfig.*.json", "**/requirements*.txt"]


def glob_to_regex(glob: str) -> str:
    """``**`` crosses folders, ``*`` and ``?`` stay within one, ``{a,b}`` is a choice; the whole path must match."""
    out, i, depth = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i):
            out += "(?:[^/]+/)*"
            i += 3
            continue
        if glob.startswith("**", i):
            out += ".*"
            i += 2
            continue
        if c == "*":
            out += "[^/]*"
        elif c == "?":
            out += "[^/]"
        elif c == "{":
            out, depth = out + "(?:", depth + 1
        elif c == "}" and depth:
            out, depth = out + ")", depth - 1
        elif c == "," and depth:
            out += "|"
        else:
            out += re.escape(c)
        i += 1
    return f"^{out}$"


def any_of(globs: list[str]) -> str:
    """One regular expression for a list of globs; one that matches nothing for an empty list."""
    return "|".join(dict.fromkeys(map(glob_to_regex, globs))) or r"^\b$"


def ignore_rules(text: str, folder: str) -> list[str]:
    """Globs for an ignore file's lines.  Negations aren't supported and are reported."""
    out = []
    for line in map(str.strip, text.split("\n")):
        if not line or line[0] == "#":
            continue
        if line[0] == "!":
            log.warning("ignored the negation %s in %s", line, folder or ".")
            continue
        rule = line.removeprefix("/").removesuffix("/")
        free = "/" not in rule and line[0] != "/"
        out.append(f"{folder + '/' if folder else ''}{'**/' if free else ''}{rule}{'/**' if line[-1] == '/' else ''}")
    return list(dict.fromkeys(out))


def load_ignore_files(root: str) -> list[str]:
    """The rules of every ``.gitignore`` below a local root, each for its own folder."""
    out: list[str] = []
    for folder, folders, names in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in ("node_modules", ".git"))
        if ".gitignore" in names:
            with open(os.path.join(folder, ".gitignore"), encoding="utf-8", errors="replace") as f:
                where = os.path.relpath(folder, root)
                out += ignore_rules(f.read(), "" if where == "." else where.replace(os.sep, "/"))
    return list(dict.fromkeys(out))
