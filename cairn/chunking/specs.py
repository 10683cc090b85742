"""Declarations of each language, as patterns over the masked source.

Rules stand in the order in which chunks are emitted.  Names are word characters unless a language needs more.
"""

from __future__ import annotations

from .scanner import Lexis, Rule, Spec

_B = r"^[ \t]*"  # a line's beginning
_N = r"(?P<name>[A-Za-z_$][\w$]*)"
_HASH = Lexis(line=("#",), block=(), strings=('"', "'"))
_C = Lexis(char=True)
_EXTENDS = (("EXTENDS", r"\bextends\s+(?P<names>[\w.$]+)"),)
_BASES = (("EXTENDS", r"(?<!:):(?!:)\s*(?P<names>[^{]+)"),)


def _r(pattern: str, type: str, **options) -> Rule:
    return Rule(pattern, type, **options)


_EXPORT = r"(?:export[ \t]+)?(?:default[ \t]+)?(?:declare[ \t]+)?"
_MEMBER = rf"{_B}(?:(?:public|private|protected|static|readonly|abstract|async|override|get|set)[ \t]+)*\*?[ \t]*(?P<name>#?[A-Za-z_$][\w$]*)[ \t]*(?:<[^>\n]*>)?\((?=[^;]*?\)[^;={{}}]*\{{)"
_JS_RULES = (
    _r(rf"{_B}{_EXPORT}(?:async[ \t]+)?function[ \t]+{_N}", "function"),
    _r(rf"{_B}{_EXPORT}(?:async[ \t]+)?function[ \t]*\*[ \t]*{_N}", "function"),
    _r(rf"{_B}{_EXPORT}(?:const|let|var)[ \t]+{_N}[^=\n]*=\s*(?=(?:async\b[ \t]*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)[^=;{{}}\n]*=>))", "function", end="stmt"),
    _r(rf"{_B}{_EXPORT}(?:abstract[ \t]+)?class[ \t]+{_N}", "class"),
    _r(_MEMBER, "method", place="member"),
)
_JS_CONST = _r(rf"{_B}(?:export[ \t]+)?const[ \t]+{_N}(?:[ \t]*:[^=\n]+)?[ \t]*=(?!\s*(?:async\b[ \t]*)?(?:function\b|(?:\([^()]*(?:\([^()]*\)[^()]*)*\)|[\w$]+)[^=;{{}}\n]*=>))", "const", place="top", end="stmt", least=40)
_JS = dict(lexis=Lexis(strings=('"', "'", "`")), imports=r"^[ \t]*(?:import\b[^;'\"`()]*?|export\s+(?:type\s+)?(?:\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*)['\"](?P<module>[^'\"\n]+)['\"];?", heritage=_EXTENDS, containers=("class",), calls=r"(?<![\w$])(?:new[ \t]+)?(?:[\w$]+\??\.)*(?P<callee>[A-Za-z_$][\w$]*)[ \t]*(?:<[^<>()\n]*>)?\(", header=True)

SPECS: dict[str, Spec] = {
    "javascript": Spec((*_JS_RULES, _JS_CONST), **_JS),
    "typescript": Spec(
        (
            *_JS_RULES,
            _r(rf"{_B}{_EXPORT}interface[ \t]+{_N}", "interface"),
            _r(rf"{_B}{_EXPORT}type[ \t]+{_N}[^=\n]*=", "type", end="stmt"),
            _r(rf"{_B}{_EXPORT}(?:const[ \t]+)?enum[ \t]+{_N}", "enum"),
            _r(rf"{_B}{_EXPORT}(?:namespace|module)[ \t]+(?P<name>[\w.$]+)", "namespace"),
            _JS_CONST,
        ),
        **_JS,
    ),
    "python": Spec(
        (
            _r(rf"{_B}class[ \t]+{_N}", "class"), _r(rf"{_B}(?:async[ \t]+)?def[ \t]+{_N}", "function"), _r(rf"{_B}type[ \t]+{_N}[^=\n]*=", "typealias", end="stmt"),
            _r(rf"^{_N}(?:[ \t]*:[^=\n]+)?[ \t]*=(?!=)", "const", end="stmt", least=40),
        ),
        lexis=Lexis(line=("#",), block=(), long=(('"""', '"""'), ("'''", "'''"))), end="indent", imports=r"^[ \t]*(?:from[ \t]+(?P<module>[\w.]+)[ \t]+import\b(?:[ \t]*\([^)]*\)|[^\n]*)|import[ \t]+(?P<module2>[\w.]+)[^\n]*)", heritage=(("EXTENDS", r"\((?P<names>[^)=]*)"),), containers=("class",),
    ),
    "go": Spec(
        (
            _r(rf"^func[ \t]+{_N}[ \t]*(?:\[[^\]\n]*\])?\(", "function"), _r(rf"^func[ \t]+\([ \t]*(?:\w+[ \t]+)?\*?(?P<parent>\w+)(?:\[[^\]]*\])?[ \t]*\)[ \t]*{_N}", "method"),
            _r(rf"^(?:type[ \t]+|[ \t]+){_N}(?:\[[^\]\n]*\])?[ \t]+struct\b", "struct"), _r(rf"^(?:type[ \t]+|[ \t]+){_N}(?:\[[^\]\n]*\])?[ \t]+interface\b", "interface"),
            _r(rf"^type[ \t]+{_N}[ \t]*=", "typealias", end="line"), _r(rf"^type[ \t]+{_N}[ \t]+(?!struct\b|interface\b|=)", "type", end="stmt"),
            _r(rf"^const[ \t]+{_N}", "const", end="stmt", least=40), _r(rf"^var[ \t]+{_N}", "variable", end="stmt", least=40),
        ),
        lexis=Lexis(strings=('"', "`", "'"), char=True), imports=r'^[ \t]*(?:import[ \t]+(?:[\w.]+[ \t]+)?|(?<=\t)(?:[\w.]+[ \t]+)?)"(?P<module>[^"\n]+)"[ \t]*$', containers=("struct", "interface"),
    ),
    "rust": Spec(
        (
            _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+{_N}", "struct"), _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+{_N}", "enum"), _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+{_N}", "trait"),
            _r(rf"{_B}(?:unsafe[ \t]+)?impl(?:<[^{{]*?>)?[ \t]+(?:[\w:<>,' &]+?[ \t]+for[ \t]+)?(?:\w+::)*{_N}", "class"), _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+{_N}", "module"),
            _r(rf"{_B}macro_rules![ \t]*{_N}", "macro"), _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?(?:const|static)[ \t]+(?:mut[ \t]+)?(?!fn\b){_N}[ \t]*:", "const", end="stmt", least=40),
            _r(rf"{_B}(?:pub(?:\([^)]*\))?[ \t]+)?type[ \t]+{_N}", "typealias", end="stmt"),
            _r(rf'{_B}(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern(?:[ \t]+"[^"]*")?)[ \t]+)*fn[ \t]+{_N}', "function"),
        ),
        lexis=Lexis(char=True), imports=r"^[ \t]*(?:pub[ \t]+)?use[ \t]+(?P<module>[\w:]+)[^;]*;", containers=("class", "trait"), parent_label="Impl", calls=r"(?<![\w!])(?:\w+(?:\.|::))*(?P<callee>[A-Za-z_]\w*)(?:::<[^>]*>)?\(",
    ),
    "java": Spec(
        (
            _r(rf"{_B}(?:(?:public|protected|private|static|final|abstract|sealed|non-sealed|strictfp)[ \t]+)*class[ \t]+{_N}", "class"), _r(rf"{_B}(?:(?:public|protected|private|static|sealed|abstract)[ \t]+)*interface[ \t]+{_N}", "interface"),
            _r(rf"{_B}(?:(?:public|protected|private|static)[ \t]+)*enum[ \t]+{_N}", "enum"), _r(rf"{_B}(?:(?:public|protected|private|static|final)[ \t]+)*record[ \t]+{_N}", "record"),
            _r(rf"{_B}(?:(?:public|protected|private|static|final|abstract|synchronized|native|default)[ \t]+)*(?:<[^>\n]+>[ \t]+)?(?:[\w.<>,?\[\] &]+[ \t]+)?{_N}[ \t]*\((?=[^;{{}}]*\)[^;{{}}=]*[;{{])", "method", place="member"),
        ),
        lexis=_C, imports=r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<module>[\w.*]+)[ \t]*;", heritage=(*_EXTENDS, ("IMPLEMENTS", r"\bimplements\s+(?P<names>[\w.,<> \t\n]+)")), containers=("class", "interface", "enum", "record"),
    ),
    "c": Spec(
        (
            _r(rf"^(?:typedef[ \t]+)?(?:struct|union)[ \t]+{_N}(?=\s*\{{)", "struct"), _r(rf"^(?:typedef[ \t]+)?enum[ \t]+{_N}(?=\s*\{{)", "enum"), _r(r"^typedef\b[^;{]*(?:\{[^}]*\})?[^;]*?(?P<name>\w+)[ \t]*(?=;)", "typealias", end="stmt"),
            _r(rf"^[ \t]*#[ \t]*define[ \t]+{_N}", "macro", end="line", least=20), _r(rf"^(?!typedef|else|return)[A-Za-z_][\w \t*]*?[ \t*]{_N}[ \t]*\((?=[^;{{}}]*\)\s*\{{)", "function"),
        ),
        lexis=_C, imports=r'^[ \t]*#[ \t]*include[ \t]*[<"](?P<module>[^>"\n]+)[>"]', containers=("struct",),
    ),
    "cpp": Spec(
        (
            _r(rf"{_B}(?:template[ \t]*<[^{{;]*>\s*)?class[ \t]+{_N}(?=[^;(){{]*\{{)", "class"), _r(rf"{_B}(?:template[ \t]*<[^{{;]*>\s*)?(?:typedef[ \t]+)?(?:struct|union)[ \t]+{_N}(?=[^;(){{]*\{{)", "struct"),
            _r(rf"{_B}(?:typedef[ \t]+)?enum[ \t]+(?:class[ \t]+|struct[ \t]+)?{_N}(?=[^;(){{]*\{{)", "enum"), _r(rf"{_B}namespace[ \t]+(?P<name>[\w:]+)(?=\s*\{{)", "namespace"),
            _r(rf"{_B}(?:template[ \t]*<[^{{;]*>\s*)?using[ \t]+{_N}[ \t]*=", "typealias", end="stmt"), _r(r"^[ \t]*typedef\b[^;{]*?(?P<name>\w+)[ \t]*(?=;)", "typealias", end="stmt"),
            _r(rf"{_B}(?!else\b|return\b|throw\b|new\b|delete\b|case\b)(?:template[ \t]*<[^{{;]*>\s*)?(?:[A-Za-z_][\w:<>,&* \t]*?[ \t*&])?(?P<name>~?[A-Za-z_]\w*)[ \t]*\((?=[^;{{}}]*\)[^;{{}}=]*\{{)", "function", member_type="method"),
        ),
        lexis=_C, imports=r'^[ \t]*#[ \t]*include[ \t]*[<"](?P<module>[^>"\n]+)[>"]', heritage=_BASES, containers=("class", "struct"),
    ),
    "csharp": Spec(
        (
            *(_r(rf"{_B}(?:(?:public|private|protected|internal|static|sealed|abstract|partial|readonly|ref|file)[ \t]+)*{w}[ \t]+{_N}", t) for w, t in (("class", "class"), (r"record(?:[ \t]+(?:class|struct))?", "record"), ("struct", "struct"), ("interface", "interface"), ("enum", "enum"))),
            _r(rf"{_B}(?:(?:public|private|protected|internal)[ \t]+)*delegate[ \t]+[\w.<>\[\]?]+[ \t]+{_N}", "typealias", end="stmt"),
            _r(rf"{_B}(?:(?:public|private|protected|internal|static|virtual|override|abstract|sealed|async|extern|partial|new|unsafe)[ \t]+)*(?:[\w.<>,\[\]? ]+[ \t]+)?{_N}[ \t]*(?:<[^>\n]*>)?\((?=[^;{{}}]*\)[^;{{}}]*(?:\{{|=>|;))", "method", place="member"),
            _r(rf"{_B}(?:(?:public|private|protected|internal|static|virtual|override|abstract|required|new)[ \t]+)+[\w.<>,\[\]?]+[ \t]+{_N}[ \t\n]*(?=\{{\s*(?:(?:private|protected|internal)\s+)?(?:get|set|init)\b|=>)", "property", place="member"),
            _r(rf"{_B}(?:(?:public|private|protected|internal|static|virtual)[ \t]+)*event[ \t]+[\w.<>?]+[ \t]+{_N}", "event", place="member"),
        ),
        lexis=_C, imports=r"^[ \t]*(?:global[ \t]+)?using[ \t]+(?:static[ \t]+)?(?:\w+[ \t]*=[ \t]*)?(?P<module>[\w.]+)[ \t]*;", heritage=_BASES, containers=("class", "record", "struct", "interface"),
    ),
    "swift": Spec(
        (
            *(_r(rf"{_B}(?:(?:public|private|fileprivate|internal|open|final|indirect)[ \t]+)*{w}[ \t]+(?P<name>[\w.]+)", t) for w, t in (("class", "class"), ("struct", "struct"), ("enum", "enum"), ("actor", "actor"), ("extension", "extension"), ("protocol", "protocol"))),
            _r(rf"{_B}(?:(?:public|private|internal)[ \t]+)*typealias[ \t]+{_N}", "typealias", end="line"),
            _r(rf"{_B}(?:(?:public|private|fileprivate|internal|open|static|class|override|mutating|final|async|@\w+)[ \t]+)*func[ \t]+{_N}", "function", member_type="method"),
        ),
        lexis=Lexis(strings=('"',), long=(('"""', '"""'),)), imports=r"^[ \t]*(?:@\w+[ \t]+)?import[ \t]+(?:(?:class|struct|func|enum|protocol)[ \t]+)?(?P<module>[\w.]+)", heritage=_BASES, containers=("class", "struct", "enum", "actor", "extension", "protocol"),
    ),
    "kotlin": Spec(
        (
            _r(rf"{_B}(?:(?:public|private|internal|open|abstract|data|sealed|inner|value|annotation)[ \t]+)*class[ \t]+{_N}", "class"), _r(rf"{_B}(?:(?:public|private|internal|sealed|fun)[ \t]+)*interface[ \t]+{_N}", "interface"),
            _r(rf"{_B}(?:(?:public|private|internal)[ \t]+)*enum[ \t]+class[ \t]+{_N}", "enum"), _r(rf"{_B}(?:(?:public|private|internal|companion|data)[ \t]+)*object[ \t]+{_N}", "object"), _r(rf"{_B}(?:(?:public|private|internal)[ \t]+)*typealias[ \t]+{_N}", "typealias", end="line"),
            _r(rf"{_B}(?:(?:public|private|internal|protected|open|override|abstract|suspend|inline|infix|operator|tailrec)[ \t]+)*fun[ \t]+(?:<[^>\n]*>[ \t]*)?(?:[\w.<>?]+\.)?{_N}", "function", member_type="method"),
        ),
        lexis=Lexis(char=True, long=(('"""', '"""'),)), imports=r"^[ \t]*import[ \t]+(?P<module>[\w.*]+)", heritage=(("EXTENDS", r"\)?\s*:\s*(?P<names>[^{]*?\()"), ("IMPLEMENTS", r"\)?\s*[:,]\s*(?P<names>[\w., \t]+)$")), containers=("class", "interface", "enum", "object"),
    ),
    "ruby": Spec(
        (
            _r(rf"{_B}(?:class|module)[ \t]+(?P<name>[A-Z][\w:]*)", "class"), _r(rf"{_B}(?:private[ \t]+)?def[ \t]+(?:self\.)?(?P<name>\w+[?!=]?)", "function", member_type="method"),
            _r(rf"{_B}(?P<name>after_action|after_create|after_save|attr_accessor|attr_reader|attr_writer|before_action|before_create|before_save|belongs_to|delegate|enum|extend|has_and_belongs_to_many|has_many|has_one|include|prepend|scope|serialize|validate|validates)\b", "dsl_call", place="member", end="line"),
        ),
        lexis=Lexis(line=("#",), block=(("=begin", "=end"),)), end="keyword", openers=r"^[ \t]*(?:(?:private|public|protected)[ \t]+)?(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:[ \t]*\|[^|\n]*\|)?[ \t]*$|=[ \t]*(?:if|case|begin|unless)\b",
        imports=r"^[ \t]*require(?:_relative)?[ \t(]+['\"](?P<module>[^'\"\n]+)['\"]", heritage=(("EXTENDS", r"<\s*(?P<names>[\w:]+)"),), containers=("class",), calls=r"(?<![\w.@:])(?:[\w@]+\.)*(?P<callee>[a-z_]\w*[?!]?)\(",
    ),
    "php": Spec(
        (
            _r(rf"{_B}function[ \t]+&?{_N}", "function", place="top"), *(_r(rf"{_B}(?:(?:abstract|final|readonly)[ \t]+)*{w}[ \t]+{_N}", w) for w in ("class", "interface", "trait", "enum")),
            _r(rf"{_B}(?:(?:public|private|protected)[ \t]+)?const[ \t]+(?:\w+[ \t]+)?{_N}[ \t]*=", "const", end="stmt", least=40), _r(rf"{_B}(?:(?:public|private|protected|static|readonly|var)[ \t]+)+(?:\??[\w|\\]+[ \t]+)?\$(?P<name>\w+)", "property", place="member", end="stmt"),
            _r(rf"{_B}(?:(?:public|private|protected|static|abstract|final)[ \t]+)*function[ \t]+&?{_N}", "method", place="member"),
        ),
        lexis=Lexis(line=("//", "#")), imports=r"^use[ \t]+(?:function[ \t]+|const[ \t]+)?(?P<module>[\w\\]+)[^;(]*;", heritage=(("EXTENDS", r"\bextends\s+(?P<names>(?:(?!implements)[\w\\, ])+)"), ("IMPLEMENTS", r"\bimplements\s+(?P<names>[\w\\, \n]+)")), containers=("class", "interface", "trait", "enum"), calls=r"(?<![\w$])(?:[$\w]+(?:->|::))*(?P<callee>[A-Za-z_]\w*)\s*\(",
    ),
    "bash": Spec((_r(r"^[ \t]*(?:function[ \t]+(?P<name>[\w:-]+)[ \t]*(?:\(\))?|(?P<name2>[\w:-]+)[ \t]*\(\))(?=\s*[{(])", "function"), _r(rf"^(?:(?:export|readonly|declare(?:[ \t]+-\w+)?)[ \t]+)*{_N}=", "const", place="top", end="line", least=40)), lexis=_HASH, imports=r"^[ \t]*(?:source|\.)[ \t]+['\"]?(?P<module>[^\s'\";]+)", mark=("#", ""), calls=r"(?:^|[;&|(`]|\bthen\b|\bdo\b)[ \t]*(?P<callee>[A-Za-z_][\w-]*)(?=[ \t\n;)]|$)", containers=()),
    "scala": Spec(
        (
            _r(rf"{_B}(?:(?:abstract|final|sealed|implicit|private|protected|open)[ \t]+)*(?<!case )class[ \t]+{_N}", "class"), _r(rf"{_B}(?:(?:final|sealed|private|protected)[ \t]+)*case[ \t]+class[ \t]+{_N}", "record"), _r(rf"{_B}(?:(?:case|private|implicit)[ \t]+)*object[ \t]+{_N}", "object"), _r(rf"{_B}(?:(?:sealed|private)[ \t]+)*trait[ \t]+{_N}", "trait"),
            _r(rf"{_B}enum[ \t]+{_N}", "enum"), _r(rf"{_B}(?:opaque[ \t]+)?type[ \t]+{_N}", "typealias", end="line"), _r(rf"{_B}given[ \t]+{_N}", "instance"), _r(rf"{_B}(?:(?:override|private|protected|final|implicit|inline|lazy)(?:\[\w+\])?[ \t]+)*def[ \t]+{_N}", "function", member_type="method"),
        ),
        lexis=Lexis(char=True, long=(('"""', '"""'),)), imports=r"^[ \t]*import[ \t]+(?P<module>[\w.]+)", heritage=(("EXTENDS", r"\b(?:extends|with)\s+(?P<names>[\w.]+)"),), containers=("class", "record", "object", "trait", "enum", "instance"),
    ),
    "lua": Spec((_r(r"^[ \t]*(?:local[ \t]+)?function[ \t]+(?P<name>[\w.:]+)", "function"), _r(r"^[ \t]*(?:local[ \t]+)?(?P<name>[\w.]+)[ \t]*=[ \t]*function\b", "function")), lexis=Lexis(line=("--",), block=(("--[[", "]]"),), long=(("[[", "]]"),)), end="keyword", openers=r"\bfunction\b|\bif\b|\bdo\b", imports=r"\brequire[ \t]*\(?[ \t]*['\"](?P<module>[^'\"\n]+)['\"]", mark=("--", ""), calls=r"(?<![\w.:])(?:\w+[.:])*(?P<callee>[A-Za-z_]\w*)\s*\(", containers=()),
    "r": Spec((_r(r"^[ \t]*(?P<name>[\w.]+)[ \t]*(?:<-|=)[ \t]*function\b", "function", end="stmt"), *(_r(rf"^[ \t]*{f}\([ \t\n]*[\"'](?P<name>[^\"'\n]+)[\"']", t, end="paren") for f, t in (("setClass", "class"), ("setMethod", "method"), ("setGeneric", "function")))), lexis=_HASH, imports=r"^[ \t]*(?:library|require)[ \t]*\([ \t]*['\"]?(?P<module>[\w.]+)", mark=("#", ""), containers=()),
    "dart": Spec(
        (
            _r(rf"{_B}(?:(?:abstract|final|sealed|base)[ \t]+)*class[ \t]+{_N}", "class"), _r(rf"{_B}(?:base[ \t]+)?mixin[ \t]+{_N}", "mixin"), _r(rf"{_B}extension[ \t]+{_N}", "extension"), _r(rf"{_B}enum[ \t]+{_N}", "enum"), _r(rf"{_B}typedef[ \t]+{_N}", "typealias", end="stmt"),
            _r(rf"{_B}(?!return\b|else\b|await\b)(?:(?:static|external|override|final)[ \t]+)*(?:[\w<>,?\[\] ]+[ \t]+)?{_N}[ \t]*\((?=[^;{{}}]*\)[ \t]*(?:async\*?|sync\*)?[ \t]*(?:\{{|=>))", "function", member_type="method"),
        ),
        imports=r"^[ \t]*(?:import|export)[ \t]+['\"](?P<module>[^'\"\n]+)['\"][^;]*;", heritage=(*_EXTENDS,), containers=("class", "mixin", "extension", "enum"), calls=None,
    ),
    "haskell": Spec(
        (
            _r(r"^(?!type\b|data\b|class\b|instance\b|newtype\b|module\b|import\b|where\b|infix)(?P<name>[a-z_][\w']*)(?=[^\n]*(?<![=<>])=(?!=)|[^\n]*\n[ \t]+\|)", "function", end="blank"), _r(r"^data[ \t]+(?P<name>[A-Z][\w']*)", "type", end="blank"), _r(r"^class[ \t]+(?:[^\n]*=>[ \t]*)?(?P<name>[A-Z][\w']*)", "class", end="blank"),
            _r(r"^instance[ \t]+(?P<name>[^\n]+?)[ \t]*(?=where|\n)", "instance", end="blank"), _r(r"^newtype[ \t]+(?P<name>[A-Z][\w']*)", "newtype", end="blank"), _r(r"^type[ \t]+(?:family[ \t]+)?(?P<name>[A-Z][\w']*)", "typealias", end="blank"),
        ),
        lexis=Lexis(line=("--",), block=(("{-", "-}"),), strings=('"',)), end="blank", imports=r"^import[ \t]+(?:qualified[ \t]+)?(?P<module>[\w.]+)", mark=("--", ""), containers=("class", "instance"), calls=r"(?:=|\(|\$|<-)[ \t]*(?P<callee>[a-z_][\w']*)[ \t]+[\w(\"\[]",
    ),
    "elixir": Spec(
        (
            _r(rf"{_B}defmodule[ \t]+(?P<name>[\w.]+)", "module"), _r(rf"{_B}defprotocol[ \t]+(?P<name>[\w.]+)", "protocol"), _r(rf"{_B}defimpl[ \t]+(?P<name>[\w.]+)", "instance"),
            _r(rf"{_B}defp?[ \t]+(?P<name>\w+[?!]?)", "function", member_type="method"), _r(rf"{_B}defmacrop?[ \t]+(?P<name>\w+[?!]?)", "macro"),
        ),
        lexis=Lexis(line=("#",), block=(), strings=('"',), long=(('"""', '"""'),)), end="keyword", openers=r"\bdo\b(?!:)|\bfn\b", imports=r"^[ \t]*(?:alias|import|use)[ \t]+(?P<module>[\w.]+)", mark=("#", ""), parent_label="Module", containers=("module", "protocol", "instance"), calls=r"(?<![\w:])(?:[\w]+\.)*(?P<callee>[a-z_]\w*[?!]?)\(",
    ),
    "clojure": Spec(
        tuple(_r(rf"^\(\s*{w}\s+(?:\^\S+\s+)*(?P<name>[^\s()\[\]{{}}]+)", t, least=n) for w, t, n in (("defn-?", "function", 0), ("defmacro", "macro", 0), ("defprotocol", "protocol", 0), ("(?:defrecord|deftype)", "record", 0), ("(?:defmulti|defmethod)", "method", 0), ("(?:def|defonce)", "const", 40))),
        lexis=Lexis(line=(";",), block=(), strings=('"',)), end="paren", imports=r"^\(ns\s+[^\s()]+|\[(?P<module>[\w.-]+\.[\w.-]+|[\w-]+)[ \t]+:(?:as|refer)", mark=(";", ""), containers=(), calls=r"\((?P<callee>[a-z][\w!?*<>=-]*)(?=[\s)])",
    ),
    "groovy": Spec((_r(rf"{_B}(?:(?:public|private|abstract|final)[ \t]+)*(?:class|interface|trait|enum)[ \t]+{_N}", "class"), _r(rf"{_B}(?:(?:public|private|protected|static|final)[ \t]+)*(?:def|void|[A-Z][\w<>\[\]]*|int|boolean|long|double)[ \t]+{_N}[ \t]*\((?=[^;{{}}]*\)[^;{{}}]*\{{)", "function", member_type="method"), _r(rf"^def[ \t]+{_N}[ \t]*=(?=[ \t]*\{{)", "function")), lexis=Lexis(long=(('"""', '"""'), ("'''", "'''"))), imports=r"^[ \t]*import[ \t]+(?:static[ \t]+)?(?P<module>[\w.*]+)", containers=("class",)),
    "perl": Spec((_r(r"^[ \t]*sub[ \t]+(?P<name>\w+)", "function"), _r(r"^[ \t]*has[ \t]+(?:['\"](?P<name>[^'\"\n]+)['\"]|(?P<name2>\w+))", "property", end="stmt")), lexis=Lexis(line=("#",), block=(("\n=pod", "\n=cut"), ("\n=head1", "\n=cut"))), imports=r"^[ \t]*use[ \t]+(?P<module>[A-Z][\w:]*)", mark=("#", ""), calls=None, containers=()),
    "powershell": Spec((_r(rf"{_B}(?i:class)[ \t]+{_N}", "class"), _r(r"^[ \t]*(?i:function|filter)[ \t]+(?P<name>[\w:-]+)", "function"), _r(r"^[ \t]+(?:hidden[ \t]+|static[ \t]+)*(?:\[[\w.\[\]]+\][ \t]*)?(?P<name>\w+)[ \t]*\((?=[^;{}\n]*\)\s*\{)", "method", place="member"), _r(r"^(?i:param)[ \t]*(?=\()", "param_block", place="top", end="stmt", name="param")), lexis=Lexis(line=("#",), block=(("<#", "#>"),)), imports=r"^[ \t]*(?i:using)[ \t]+(?:module|namespace)[ \t]+(?P<module>[\w./\\-]+)", mark=("#", ""), containers=("class",), calls=r"(?:^|[;|(={])[ \t]*(?P<callee>[A-Z]\w*-\w+)"),
    "matlab": Spec((_r(rf"^[ \t]*classdef[ \t]+(?:\([^)]*\)[ \t]*)?{_N}", "class"), _r(rf"^[ \t]*function[ \t]+(?:(?:\[[^\]]*\]|\w+)[ \t]*=[ \t]*)?(?:\w+\.)?{_N}", "function", member_type="method"), _r(r"^[ \t]*(?P<name>properties)\b", "property", place="member")), lexis=Lexis(line=("%",), block=(("%{", "%}"),), strings=('"',)), end="keyword", openers=r"^[ \t]*(?:classdef|function|properties|methods|events|enumeration|if|for|while|switch|try|parfor)\b", mark=("%", ""), containers=("class",)),
    "zig": Spec((_r(rf"{_B}(?:pub[ \t]+)?const[ \t]+{_N}[ \t]*=[ \t]*(?:packed[ \t]+|extern[ \t]+)?(?:struct|union)\b", "struct", end="stmt"), _r(rf"{_B}(?:pub[ \t]+)?const[ \t]+{_N}[ \t]*=[ \t]*enum\b", "enum", end="stmt"), _r(r'^[ \t]*test[ \t]+"(?P<name>[^"\n]*)"', "test"), _r(rf"{_B}(?:pub[ \t]+)?(?:export[ \t]+|inline[ \t]+)?fn[ \t]+{_N}", "function", member_type="method")), lexis=Lexis(block=(), strings=('"',)), imports=r'@import\([ \t]*"(?P<module>[^"\n]+)"', calls=None, containers=("struct", "enum")),
    "solidity": Spec(
        (
            _r(rf"{_B}(?:abstract[ \t]+)?contract[ \t]+{_N}", "class"), _r(rf"{_B}interface[ \t]+{_N}", "interface"), _r(rf"{_B}event[ \t]+{_N}", "event", end="stmt"), _r(rf"{_B}modifier[ \t]+{_N}", "modifier"), _r(rf"{_B}library[ \t]+{_N}", "library"), _r(rf"{_B}struct[ \t]+{_N}", "struct"), _r(rf"{_B}enum[ \t]+{_N}", "enum"), _r(rf"{_B}error[ \t]+{_N}", "error", end="stmt"),
            _r(rf"{_B}(?!return\b|function\b|event\b|using\b|import\b|error\b)(?:mapping[ \t]*\([^;]*\)|[\w.\[\]]+)[ \t]+(?:(?:public|private|internal|constant|immutable|override)[ \t]+)*{_N}[ \t]*(?==[^=]|;)", "state_variable", place="member", end="stmt", least=30), _r(rf"{_B}function[ \t]+{_N}", "function", member_type="method"),
        ),
        imports=r"^[ \t]*import\b[^;'\"]*['\"](?P<module>[^'\"\n]+)['\"][^;]*;", heritage=(("EXTENDS", r"\bis\s+(?P<names>[\w., \n]+)"),), containers=("class", "interface", "library"), parent_label="Contract",
    ),
    "julia": Spec((_r(rf"{_B}(?:bare)?module[ \t]+{_N}", "module"), _r(r"^[ \t]*function[ \t]+(?:\w+\.)?(?P<name>\w+!?)", "function", member_type="method"), _r(rf"{_B}(?:mutable[ \t]+)?struct[ \t]+{_N}", "struct"), _r(r"^[ \t]*macro[ \t]+(?P<name>\w+)", "macro"), _r(rf"{_B}abstract[ \t]+type[ \t]+{_N}", "type", end="line"), _r(rf"^const[ \t]+{_N}[ \t]*=", "const", end="line", least=40)), lexis=Lexis(line=("#",), block=(("#=", "=#"),), strings=('"',), long=(('"""', '"""'),)), end="keyword", openers=r"^[ \t]*(?:(?:bare)?module|function|(?:mutable[ \t]+)?struct|macro|if|for|while|begin|let|try|quote)\b|\bdo\b", imports=r"^[ \t]*(?:using|import)[ \t]+(?P<module>[\w.]+)", mark=("#", ""), parent_label="Module", containers=("module", "struct"), calls=r"(?<![\w.@])(?:\w+\.)*(?P<callee>[A-Za-z_]\w*!?)\("),
    "ocaml": Spec((_r(r"^[ \t]*module[ \t]+type[ \t]+(?P<name>\w+)", "module_type"), _r(r"^[ \t]*module[ \t]+(?!type\b)(?P<name>\w+)(?=[ \t]*\()", "functor"), _r(r"^[ \t]*module[ \t]+(?!type\b)(?P<name>\w+)(?![ \t]*\(|\w)", "module"), _r(r"^[ \t]*let[ \t]+(?:rec[ \t]+)?(?P<name>[a-z_][\w']*)(?![^\n]*\bin\b)", "function"), _r(r"^[ \t]*type[ \t]+(?:'\w+[ \t]+|\([^)]*\)[ \t]+)?(?P<name>[a-z_][\w']*)", "type")), lexis=Lexis(line=(), block=(("(*", "*)"),), strings=('"',)), end="indent", imports=r"^[ \t]*open[ \t]+(?P<module>[\w.]+)", mark=("(*", " *)"), containers=("module",), calls=None),
    "erlang": Spec((_r(r"^-record\([ \t]*(?P<name>\w+)", "record", end="dot"), _r(r"^(?P<name>[a-z]\w*)\((?=[^\n]*(?:->|when|\n))", "function", end="dot")), lexis=Lexis(line=("%",), block=(), strings=('"',)), end="dot", imports=r"^-(?:module\([ \t]*(?P<module>\w+)[ \t]*\)|export\([^)]*\))[ \t]*\.", mark=("%", ""), containers=(), calls=r"(?<![\w])(?:\w+:)?(?P<callee>[a-z]\w*)\("),
    "objc": Spec((_r(rf"^@interface[ \t]+{_N}(?![ \t]*\()", "class", end="keyword"), _r(rf"^@protocol[ \t]+{_N}(?![^\n]*;)", "protocol", end="keyword"), _r(rf"^@(?:interface|implementation)[ \t]+{_N}(?=[ \t]*\()", "extension", end="keyword"), _r(rf"^@implementation[ \t]+{_N}(?![ \t]*\()", "class", end="keyword"), _r(r"^@property\b[^;\n]*?(?P<name>\w+)[ \t]*(?=;)", "property", end="stmt"), _r(r"^[-+][ \t]*\([^)\n]*\)[ \t]*(?P<name>\w+)", "method")), lexis=_C, openers=r"^@(?:interface|protocol|implementation)\b", closer=r"^@end\b", imports=r'^[ \t]*#import[ \t]*[<"](?P<module>[^>"\n]+)[>"]', containers=("class", "protocol", "extension"), calls=r"(?<![\w@])(?P<callee>[A-Za-z_]\w*)\s*\("),
}
