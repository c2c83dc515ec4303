"""Lexers and parsing-expression grammars of the languages whose files are checked."""

from __future__ import annotations

import re
from functools import cache

from lodeweave.llm.peg import Grammar, Tokens

# Reserved words.
JAVA_WORDS = set("abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split())
GO_WORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
JS_WORDS = set("break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split())
PYTHON_WORDS = set("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SQL_WORDS = set("SELECT FROM WHERE GROUP ORDER HAVING LIMIT OFFSET FETCH UNION INTERSECT EXCEPT MINUS JOIN INNER LEFT RIGHT FULL CROSS NATURAL ON USING AS AND OR NOT IN IS NULL LIKE ILIKE BETWEEN EXISTS CASE WHEN THEN ELSE END CREATE INSERT INTO UPDATE DELETE SET VALUES DISTINCT WITH WINDOW RETURNING BEGIN CONSTRAINT PRIMARY FOREIGN REFERENCES UNIQUE CHECK DEFAULT".split())

_JAVA_LEX = re.compile(r'(?P<NL>\n)|(?P<SP>[ \t\r\f\ufeff]+)|(?P<C>//[^\n]*|/\*.*?\*/)|(?P<STR>"""[ \t]*\n(?:\\.|[^\\])*?"""|"(?:\\.|[^"\\\n])*")|(?P<CHR>\'(?:\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.|[^\'\\\n])\')|(?P<NUM>0[xX][0-9a-fA-F_]*\.?[0-9a-fA-F_]*(?:[pP][+-]?\d+)?[lLfFdD]?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)|(?P<NAME>[^\W\d][\w$]*|\$[\w$]*)|(?P<OP>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=?|[+\-*/%&|^]=|[-+*/%&|^!~<>=?:;,.(){}\[\]@])|(?P<BAD>.)', re.S)
_GO_LEX = re.compile(r"(?P<NL>\n)|(?P<SP>[ \t\r\ufeff]+)|(?P<C>//[^\n]*|/\*.*?\*/)|(?P<STR>`[^`]*`|\"(?:\\.|[^\"\\\n])*\")|(?P<CHR>'(?:\\[^\n][^'\n]*|[^'\\\n])')|(?P<NUM>(?:0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F_]*)?(?:[pP][+-]?\d+)?|0[bBoO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)i?)|(?P<NAME>[^\W\d]\w*)|(?P<OP>\.\.\.|<<=|>>=|&\^=?|<-|\+\+|--|&&|\|\||[:+\-*/%&|^=!<>]=|<<|>>|[-+*/%&|^!<>=:;,.(){}\[\]~])|(?P<BAD>.)", re.S)
_JS_LEX = re.compile(r"(?P<NL>[\n\r\u2028\u2029])|(?P<SP>[ \t\f\v\u00a0\ufeff]+)|(?P<C>//[^\n]*|/\*.*?\*/|\A#![^\n]*)|(?P<STR>\"(?:\\(?:\r\n|.)|[^\"\\\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\n])*')|(?P<NUM>(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?)n?)|(?P<NAME>#?[^\W\d][\w$]*|#?\$[\w$]*)|(?P<OP>=>|\.\.\.|\*\*=?|\?\?=?|\?\.(?!\d)|&&=?|\|\|=?|\+\+|--|===|!==|==|!=|<=|<<=?|[+\-*%&|^]=|[-+*%&|^!~<>=?:;,.()\[\]@])|(?P<BAD>.)", re.S)
_JS_REGEX = re.compile(r"/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[A-Za-z]*")
_JS_CHUNK = re.compile(r"(?:\\.|\$(?!\{)|[^`\\$])*", re.S)
_SQL_LEX = re.compile(r"(?P<NL>\n)|(?P<SP>[ \t\r\f\ufeff]+)|(?P<C>--[^\n]*|/\*.*?\*/|\#[^\n]*)|(?P<DOLLAR>(\$\w*\$).*?\10)|(?P<STR>[NEXBneub]?'(?:''|\\.|[^'\\])*')|(?P<QID>\"(?:\"\"|[^\"])*\"|`(?:``|[^`])*`|\[[A-Za-z_][^\]\n]*\])|(?P<NUM>0[xX][0-9a-fA-F]+|(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d+)?(?![A-Za-z_]))|(?P<NAME>(?:(?<!['\"`])@{1,2})?[^\W\d][\w$#]*|\#{1,2}[^\W\d]\w*)|(?P<PAR>[:$]\w+|\?)|(?P<OP>::|:=|=>|->>?|\|\||<=>|<>|!=|<=|>=|[-+*/%&|^~<>=:;,.()\[\]{}!@])|(?P<BAD>.)".replace(r"\10", r"\5"), re.S)


def lex(pattern: re.Pattern, text: str, words: set[str], upper: bool = False) -> Tokens:
    """Tokens of a language whose lexemes do not depend on the grammar."""
    t, line, fresh, tight = Tokens(), 1, True, False
    for m in pattern.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "NL":
            line, fresh, tight = line + 1, True, False
        elif kind in ("SP", "C"):
            tight = False
            if "\n" in s:
                line, fresh = line + s.count("\n"), True
        else:
            if kind == "NAME":
                s = s.upper() if upper else s
                kind = s if s in words else kind
            elif kind == "OP":
                kind = s
            t.add(kind, s, line, fresh, tight)
            fresh, tight = False, True
            line += s.count("\n")
    return t


_GO_ENDS = {"NAME", "STR", "CHR", "NUM", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}


def lex_go(text: str) -> Tokens:
    """Go: a line that ends after certain tokens ends its statement."""
    raw = lex(_GO_LEX, text, GO_WORDS)
    t = Tokens()
    for i, key in enumerate(raw.keys):
        if raw.fresh[i] and t.keys and t.keys[-1] in _GO_ENDS:
            t.add(";", "\n", t.line[-1])
        t.add(key, raw.texts[i], raw.line[i], raw.fresh[i], raw.tight[i])
    if t.keys and t.keys[-1] in _GO_ENDS:
        t.add(";", "\n", t.line[-1])
    return t


_JS_VALUE = {"NAME", "NUM", "STR", "REGEX", "TPL", "TPLT", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"}


def lex_js(text: str) -> Tokens:
    """JavaScript and TypeScript: a slash is a division after a value and a regular expression elsewhere; templates nest."""
    t, line, fresh, tight, at = Tokens(), 1, True, False, 0
    depth: list[int] = []  # open braces within each open template

    def add(kind, s):
        nonlocal fresh, tight, line
        t.add(kind, s, line, fresh, tight)
        fresh, tight = False, True
        line += s.count("\n")

    def template(start, head, tail):
        m = _JS_CHUNK.match(text, start)
        end = m.end()
        if text.startswith("`", end):
            add(tail, text[start : end + 1])
            return end + 1, False
        if text.startswith("${", end):
            add(head, text[start : end + 2])
            return end + 2, True
        add("BAD", "`")
        return len(text), False

    while at < len(text):
        c = text[at]
        if c == "`":
            at, opened = template(at + 1, "TPLH", "TPL")
            if opened:
                depth.append(0)
            continue
        if c == "}" and depth and depth[-1] == 0:
            at, opened = template(at + 1, "TPLM", "TPLT")
            if not opened:
                depth.pop()
            continue
        if c in "{}":
            if depth:
                depth[-1] += 1 if c == "{" else -1
            add(c, c)
            at += 1
            continue
        if c == "/" and not text.startswith(("//", "/*"), at):
            m = _JS_REGEX.match(text, at) if not t.keys or t.keys[-1] not in _JS_VALUE else None
            s = m.group() if m else "/=" if text.startswith("/=", at) else "/"
            add("REGEX" if m else s, s)
            at += len(s)
            continue
        m = _JS_LEX.match(text, at)
        kind, s = m.lastgroup, m.group()
        at = m.end()
        if kind == "NL":
            line, fresh, tight = line + 1, True, False
        elif kind in ("SP", "C"):
            tight = False
            if "\n" in s:
                line, fresh = line + s.count("\n"), True
        else:
            add(s if kind == "OP" or kind == "NAME" and s in JS_WORDS else kind, s)
    if depth:
        add("BAD", "")
    return t


_PY_LEX = re.compile(r"(?P<SP>[ \t\f]+|\\\r?\n)|(?P<C>\#[^\n]*)|(?P<NL>\r?\n|\r)|(?P<STR>(?:[rR]?[bBfFtT]?|[bBfFtT][rR]|[uU])(?:\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\(?:\r\n|.)|[^\"\\\n])*\"|'(?:\\(?:\r\n|.)|[^'\\\n])*'))|(?P<NUM>(?:0[xX](?:_?[0-9a-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:(?:\d(?:_?\d)*)?\.\d(?:_?\d)*|\d(?:_?\d)*\.?)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)(?!\w)|(?:\d(?:_?\d)*)(?=(?:if|else|or|and|in|is|for|not)\b))|(?P<NAME>[^\W\d]\w*)|(?P<OP>\*\*=?|//=?|>>=?|<<=?|\.\.\.|->|:=|[-+*/%@&|^=!<>]=|[-+*/%@&|^~<>=:;,.(){}\[\]])|(?P<BAD>.)", re.S)


def lex_python(text: str) -> Tokens:
    """Python: with NEWLINE, INDENT and DEDENT."""
    t, line, at, nested = Tokens(), 1, 0, 0
    levels, begin = [0], True
    text = text.removeprefix("\ufeff")
    while at < len(text):
        if begin and not nested:
            m = re.compile(r"[ \t\f]*").match(text, at)
            ahead = text[m.end() : m.end() + 1]
            if ahead not in ("", "\n", "\r", "#"):
                width = len(m.group().replace("\f", "").expandtabs(8))
                if width > levels[-1]:
                    levels.append(width)
                    t.add("INDENT", "", line, True)
                while width < levels[-1]:
                    levels.pop()
                    t.add("DEDENT", "", line, True)
                    if width > levels[-1]:
                        t.add("BAD", "indent", line)
                        levels.append(width)
                begin = False
            at = m.end()
        m = _PY_LEX.match(text, at)
        if not m:
            break
        kind, s = m.lastgroup, m.group()
        at = m.end()
        if kind == "NL":
            if not nested and not begin:
                t.add("NEWLINE", "\n", line)
                begin = True
            line += 1
            continue
        if kind in ("SP", "C"):
            line += s.count("\n")
            continue
        if kind == "OP":
            nested += (s in "([{") - (s in ")]}" and nested > 0)
        t.add(s if kind == "OP" or kind == "NAME" and s in PYTHON_WORDS else kind, s, line)
        line += s.count("\n")
    if t.keys and not begin:
        t.add("NEWLINE", "\n", line)
    for _ in levels[1:]:
        t.add("DEDENT", "", line)
    return t


_JSON_LEX = re.compile(r'(?P<NL>\n)|(?P<SP>[ \t\r]+)|(?P<STR>"(?:\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})|[^"\\\x00-\x1f])*")|(?P<NUM>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.]))|(?P<NAME>[A-Za-z]+)|(?P<OP>[{}\[\]:,])|(?P<BAD>.)', re.S)
_XML_NAME = r"[^\W\d][\w:.·-]*"
_XML_ATTR = re.compile(rf"\s+({_XML_NAME})\s*=\s*(\"[^\"<]*\"|'[^'<]*')")
_XML_LEX = re.compile(rf"(?P<COMMENT><!--(?:(?!--).)*-->)|(?P<CDATA><!\[CDATA\[.*?\]\]>)|(?P<DECL>\A\ufeff?<\?xml\s[^?]*\?>)|(?P<PI><\?(?!xml[\s?]){_XML_NAME}(?:\s.*?)?\?>)|(?P<DOCTYPE><!DOCTYPE\s[^<>\[]*(?:\[.*?\]\s*)?>)|(?P<TAG></?{_XML_NAME}(?:\s+{_XML_NAME}\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*\s*/?>)|(?P<SPACE>\s+)|(?P<TEXT>[^<\s][^<]*)|(?P<BAD>.)", re.S)
_XML_AMP = re.compile(r"&(?!(?:\#\d+|\#x[0-9a-fA-F]+|[^\W\d][\w.-]*);)")


def lex_xml(text: str) -> Tokens:
    """XML: one token a tag; an end tag that does not name the open element is bad."""
    t, line, names = Tokens(), 1, []
    for m in _XML_LEX.finditer(text):
        kind, s = m.lastgroup, m.group()
        if kind == "TAG":
            name = re.match(r"</?([^\s/>]+)", s).group(1)
            attrs = [a for a, _ in _XML_ATTR.findall(s)]
            if s.startswith("</"):
                kind = "CLOSE" if names and names.pop() == name and not attrs and not s.endswith("/>") else "BAD"
            elif s.endswith("/>"):
                kind = "EMPTY"
            else:
                kind = "OPEN"
                names.append(name)
            if len(set(attrs)) < len(attrs) or _XML_AMP.search(s):
                kind = "BAD"
        elif kind == "TEXT" and (_XML_AMP.search(s) or "]]>" in s):
            kind = "BAD"
        t.add(kind, s[:80], line)
        line += s.count("\n")
    return t


JSON_RULES = """
File = Value EOF ;
Value = '{' (Pair (',' ~ Pair)*)? '}' / '[' (Value (',' ~ Value)*)? ']' / STR / NUM / 'true' / 'false' / 'null' ;
Pair = STR ':' Value ;
"""

XML_RULES = """
File = DECL? Misc* (DOCTYPE Misc*)? Element Misc* EOF ;
Misc = COMMENT / PI / SPACE ;
Element = EMPTY / OPEN (Element ~ / TEXT / CDATA / Misc)* CLOSE ;
"""

PYTHON_RULES = """
File = (Statement ~)* EOF ;
Statement = Decorated / If / While / For / Try / With / Def / Class / Async / Match / Line ;
Line = Small (';' Small)* ';'? NEWLINE ;
Block = ':' (NEWLINE INDENT Statement+ DEDENT / Line) ;
Decorated = ('@' Named NEWLINE)+ (Def / Class / Async) ;
Async = 'async' (Def / For / With) ;
Def = 'def' NAME TypeParams? '(' Params? ')' ('->' Tests)? Block ;
Params = Param (',' Param)* ','? ;
Param = ('**' / '*') (NAME (':' (Test / '*' Test))?)? / '/' / NAME (':' Test)? ('=' Test)? ;
Class = 'class' NAME TypeParams? ('(' Args? ')')? Block ;
TypeParams = '[' TypeParam (',' TypeParam)* ','? ']' ;
TypeParam = ('**' / '*')? NAME (':' Test)? ('=' Test)? ;
If = 'if' Named Block ('elif' Named Block)* Else? ;
Else = 'else' Block ;
While = 'while' Named Block Else? ;
For = 'for' Targets 'in' Tests Block Else? ;
Try = 'try' Block (('except' '*'? (Test (',' Test)* ('as' NAME)?)? Block)+ Else? ('finally' Block)? / 'finally' Block) ;
With = 'with' ('(' WithItem (',' WithItem)* ','? ')' &':' / WithItem (',' WithItem)*) Block ;
WithItem = Test ('as' Target)? ;
Match = 'match' Tests ':' NEWLINE INDENT ('case' Pattern (',' Pattern)* ','? ('if' Named)? Block)+ DEDENT ;
Pattern = '*' NAME / Or ('as' NAME)? ;
Small = 'pass' / 'break' / 'continue' / 'del' Targets / 'return' Tests? / 'raise' (Test ('from' Test)?)? / Global / 'assert' Test (',' Test)? / Import / TypeAlias / Assign ;
Global = ('global' / 'nonlocal') NAME (',' NAME)* ;
TypeAlias = 'type' NAME TypeParams? '=' Test ;
Import = 'import' Dotted ('as' NAME)? (',' Dotted ('as' NAME)?)* / 'from' (('.' / '...')* Dotted / ('.' / '...')+) 'import' ('*' / '(' ImportNames ','? ')' / ImportNames) ;
ImportNames = NAME ('as' NAME)? (',' NAME ('as' NAME)?)* ;
Dotted = NAME ('.' NAME)* ;
Assign = Target ':' Test ('=' (Yield / Tests))? / Targets AugOp (Yield / Tests) / (Targets '=' !'=')+ (Yield / Tests) / Yield / Tests ;
AugOp = '+=' / '-=' / '*=' / '/=' / '//=' / '%=' / '@=' / '&=' / '|=' / '^=' / '>>=' / '<<=' / '**=' ;
Yield = 'yield' ('from' Test / Tests)? ;
Targets = Target (',' Target)* ','? ;
Target = '*' Target / '(' Targets? ')' !Trailer / '[' Targets? ']' !Trailer / Store &(',' / '=' / ':' / 'in' / ')' / ']' / NEWLINE / ';' / AugOp / 'as') ;
Store = NAME !Trailer / Atom (Trailer &Trailer)* ('[' Slices ']' / '.' NAME) !Trailer ;
Tests = Starred (',' Starred)* ','? ;
Starred = '*' Bin / Named ;
Named = NAME ':=' Test / Test ;
Test = Lambda / Or ('if' Or 'else' Test)? ;
Lambda = 'lambda' (LambdaParam (',' LambdaParam)* ','?)? ':' Test ;
LambdaParam = ('**' / '*') NAME? / '/' / NAME ('=' Test)? ;
Or = Not (('or' / 'and') Not)* ;
Not = 'not' Not / Compare ;
Compare = Bin (CompareOp Bin)* ;
CompareOp = '==' / '!=' / '<=' / '>=' / '<' / '>' / 'in' / 'not' 'in' / 'is' 'not'? ;
Bin = Unary (('+' / '-' / '*' / '/' / '//' / '%' / '@' / '&' / '|' / '^' / '<<' / '>>') Unary)* ;
Unary = ('+' / '-' / '~') Unary / 'await'? Primary ('**' Unary)? ;
Primary = Atom Trailer* ;
Trailer = '(' Args? ')' / '[' Slices ']' / '.' NAME ;
Args = Arg (',' Arg)* ','? ;
Arg = '**' Test / '*' Test / NAME '=' Test / Named Comp? ;
Slices = Slice (',' Slice)* ','? ;
Slice = '*' Bin / Test? ':' Test? (':' Test?)? / Named ;
Atom = '(' (Yield / Named Comp / Tests)? ')' / '[' (Named Comp / Tests)? ']' / '{' (Dict / Named Comp / Tests)? '}' / NAME / NUM / STR+ / '...' / 'None' / 'True' / 'False' ;
Dict = DictItem (Comp / (',' DictItem)* ','?) ;
DictItem = '**' Bin / Test ':' Test ;
Comp = 'async'? 'for' Targets 'in' Or ('if' CompIf)* Comp? ;
CompIf = NAME ':=' Test / Lambda / Or ;
"""

JAVA_RULES = """
File = (Ann* 'package' Qualified ';')? (Import / ';')* (TypeDecl ~ / ';')* EOF ;
Import = 'import' 'static'? Qualified ('.' '*')? ';' / 'import' 'module' Qualified ';' ;
Qualified = NAME ('.' NAME)* ;
Ann = '@' Qualified ('(' (AnnPair (',' AnnPair)* / ElementValue)? ')')? ;
AnnPair = NAME '=' ElementValue ;
ElementValue = Ann / '{' (ElementValue (',' ElementValue)*)? ','? '}' / Ternary ;
Modifier = Ann / 'public' / 'protected' / 'private' / 'static' / 'final' / 'abstract' / 'native' / 'synchronized' / 'transient' / 'volatile' / 'strictfp' / 'default' !(':' / '->') / 'sealed' &(Modifier / 'class' / 'interface') / 'non' '-' 'sealed' ;
TypeDecl = Modifier* (Class / Interface / Enum / Record / AnnType) ;
Class = 'class' NAME TypeParams? ('extends' Type)? ('implements' Types)? ('permits' Types)? Body ;
Interface = 'interface' NAME TypeParams? ('extends' Types)? ('permits' Types)? Body ;
AnnType = '@' 'interface' NAME Body ;
Record = 'record' NAME TypeParams? '(' Params? ')' ('implements' Types)? Body ;
Enum = 'enum' NAME ('implements' Types)? '{' (Constant (',' Constant)*)? ','? (';' (Member ~)*)? '}' ;
Constant = Ann* NAME ('(' Args? ')')? Body? ;
TypeParams = '<' TypeParam (',' TypeParam)* '>' ;
TypeParam = Ann* NAME ('extends' Type ('&' Type)*)? ;
Types = Type (',' Type)* ;
Body = '{' (Member ~)* '}' ;
Member = ';' / 'static'? Block / Modifier* (Class / Interface / Enum / Record / AnnType / TypeParams? (Constructor / Method) / Field) ;
Constructor = NAME ('(' Params? ')' ('throws' Types)?)? Block ;
Method = ('void' / Type) NAME '(' Params? ')' Dims ('throws' Types)? (Block / ('default' ElementValue)? ';') ;
Field = Type Declarators ';' ;
Declarators = Declarator (',' Declarator)* ;
Declarator = NAME Dims ('=' (ArrayInit / Expr))? ;
ArrayInit = '{' ((ArrayInit / Expr) (',' (ArrayInit / Expr))*)? ','? '}' ;
Primitive = 'boolean' / 'byte' / 'char' / 'short' / 'int' / 'long' / 'float' / 'double' ;
Dims = (Ann* '[' ']')* ;
Type = Ann* (Primitive / ClassType) Dims ;
ClassType = NAME TypeArgs? ('.' Ann* NAME TypeArgs?)* ;
TypeArgs = '<' (TypeArg (',' TypeArg)*)? '>' ;
TypeArg = Ann* '?' (('extends' / 'super') Type)? / Type ;
Params = Param (',' Param)* ;
Param = (Ann / 'final')* Type Ann* '...'? (NAME ('.' 'this')? / 'this') Dims ;
Block = '{' BlockStatement* '}' ;
BlockStatement = (Ann / 'final' / 'abstract' / 'static' / 'strictfp' / 'sealed')* (Class / Interface / Enum / Record) / Local ';' / Statement ;
Local = (Ann / 'final')* Type Declarators ;
Statement = Block / ';' / 'if' '(' Expr ')' Statement ('else' Statement)? / 'while' '(' Expr ')' Statement / 'do' Statement 'while' '(' Expr ')' ';' / For / Try
  / Switch / 'synchronized' '(' Expr ')' Block / 'return' Expr? ';' / 'throw' Expr ';' / 'break' NAME? ';' / 'continue' NAME? ';' / 'assert' Expr (':' Expr)? ';'
  / 'yield' Expr ';' / NAME ':' Statement / Expr ';' ;
For = 'for' '(' ((Ann / 'final')* Type NAME Dims ':' Expr / (Local / Exprs)? ';' Expr? ';' Exprs?) ')' Statement ;
Exprs = Expr (',' Expr)* ;
Try = 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* Finally? / Block (Catch+ Finally? / Finally)) ;
Resource = (Ann / 'final')* Type NAME '=' Expr / Expr ;
Catch = 'catch' '(' (Ann / 'final')* Type ('|' Type)* NAME ')' Block ;
Finally = 'finally' Block ;
Switch = 'switch' '(' Expr ')' '{' (Label BlockStatement*)* '}' ;
Label = ('case' CaseItem (',' CaseItem)* ('when' Ternary)? / 'default') (':' / '->') ;
CaseItem = 'default' / RecordPattern / Type NAME &(':' / '->' / ',' / 'when') / Ternary ;
RecordPattern = Type '(' (Pattern (',' Pattern)*)? ')' NAME? ;
Pattern = RecordPattern / 'final'? Type NAME ;
Args = Expr (',' Expr)* ;
Expr = Lambda / Ternary (AssignOp Expr)? ;
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>' '>' '>'? '=' ;
Lambda = (NAME / '(' (Params / NAME (',' NAME)*)? ')') '->' (Block / Expr) ;
Ternary = Binary ('?' (Lambda / Ternary) ':' (Lambda / Ternary))? ;
Binary = Unary (BinaryOp Unary / 'instanceof' (Pattern / 'final'? Type))* ;
BinaryOp = '||' / '&&' / '|' / '^' / '&' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' !'=' / '>' '>' !'=' / '>' '=' / '>' !'>' / '+' / '-' / '*' / '/' / '%' ;
Unary = ('+' / '-' / '++' / '--' / '!' / '~') Unary / Cast / Postfix ;
Cast = '(' Primitive Dims ')' Unary / '(' Type ('&' Type)* ')' (Lambda / &(NAME / STR / CHR / NUM / '(' / '!' / '~' / 'this' / 'super' / 'new' / 'true' / 'false' / 'null' / 'switch' / Primitive) Unary) ;
Postfix = Primary Suffix* ('++' / '--')* ;
Suffix = '.' (TypeArgs? NAME ('(' Args? ')')? / 'this' / 'class' / 'new' Creator / 'super' ('(' Args? ')')?) / '[' Expr ']' / '::' TypeArgs? (NAME / 'new') ;
Primary = STR / NUM / CHR / 'true' / 'false' / 'null' / 'this' ('(' Args? ')')? / 'super' ('(' Args? ')' / &('.' / '::')) / '(' Expr ')' / 'new' Creator / Switch
  / Primitive Dims ('.' 'class' / '::' 'new') / 'void' '.' 'class' / TypeRef / NAME ('(' Args? ')')? / TypeArgs NAME '(' Args? ')' ;
TypeRef = NAME ('.' NAME)* (TypeArgs ('.' NAME TypeArgs?)* Dims / ('[' ']')+) &('::' / '.' 'class') ;
Creator = Ann* (Primitive / ClassType) (('[' ']')+ ArrayInit / ('[' Expr ']')+ Dims / '(' Args? ')' Body?) ;
"""

GO_RULES = """
File = ';'* 'package' NAME ';' (Import ';')* (Top ~ ';')* Top? EOF ;
Import = 'import' ('(' (ImportSpec (';' ImportSpec)*)? ';'? ')' / ImportSpec) ;
ImportSpec = ('.' / NAME)? STR ;
Top = Func / Decl ;
Decl = 'const' Group / 'var' Group / 'type' ('(' (TypeSpec (';' TypeSpec)*)? ';'? ')' / TypeSpec) ;
Group = '(' (ValueSpec (';' ValueSpec)*)? ';'? ')' / ValueSpec ;
ValueSpec = Names ('=' Exprs / Type ('=' Exprs)?)? ;
Names = NAME (',' NAME)* ;
TypeSpec = NAME TypeParams? '='? Type ;
TypeParams = '[' Names Constraint (',' Names Constraint)* ','? ']' ;
Constraint = '~'? Type ('|' '~'? Type)* ;
Func = 'func' ('(' Param? ','? ')')? NAME TypeParams? Signature Block? ;
Signature = Params (Params / Type)? ;
Params = '(' (Param (',' Param)* ','?)? ')' ;
Param = NAME '...'? Type / '...'? Type ;
Type = '(' Type ')' / '*' Type / '[' ']' Type / '[' ('...' / Expr) ']' Type / 'map' '[' Type ']' Type / ChanType / 'func' Signature / Struct / Interface / NAME ('.' NAME)? TypeArgs? ;
TypeArgs = '[' Type (',' Type)* ','? ']' ;
ChanType = '<-' 'chan' Type / 'chan' '<-'? Type ;
Struct = 'struct' '{' (FieldDecl (';' FieldDecl)*)? ';'? '}' ;
FieldDecl = (Names Type / '*'? NAME ('.' NAME)? TypeArgs?) STR? ;
Interface = 'interface' '{' (InterfaceItem (';' InterfaceItem)*)? ';'? '}' ;
InterfaceItem = NAME Signature / Constraint ;
Block = '{' Statements '}' ;
Statements = (Statement? ';')* Statement? ;
Statement = Decl / NAME ':' Statement? / If / For / Switch / Select / 'return' Exprs? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / 'go' Expr / 'defer' Expr / Block / Simple ;
Simple = Exprs (('=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') Exprs / '++' / '--' / '<-' Expr)? ;
If = 'if' HeadSimple (';' HeadSimple)? Block ('else' (If / Block))? / 'if' ';' HeadSimple Block ('else' (If / Block))? ;
HeadSimple = HeadExprs (('=' / ':=' / '+=' / '-=' / '*=' / '/=' / '%=' / '&=' / '|=' / '^=' / '<<=' / '>>=' / '&^=') ('range' HeadExpr / HeadExprs) / '++' / '--' / '<-' HeadExpr)? / 'range' HeadExpr ;
For = 'for' (Block / HeadSimple? ';' HeadExpr? ';' HeadSimple? Block / HeadSimple Block) ;
Switch = 'switch' (HeadSimple? ';')? HeadSimple? '{' ((('case' Cases / 'default') ':' Statements))* '}' ;
Cases = CaseItem (',' CaseItem)* ;
CaseItem = Expr / Type ;
Select = 'select' '{' (('case' Simple / 'default') ':' Statements)* '}' ;
Exprs = Expr (',' Expr)* ;
Expr = Unary (BinaryOp Unary)* ;
BinaryOp = '||' / '&&' / '==' / '!=' / '<=' / '>=' / '<<' / '>>' / '<' / '>' / '+' / '-' / '|' / '^' / '*' / '/' / '%' / '&^' / '&' ;
Unary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-') Unary / Primary ;
Primary = Operand Suffix* ;
Operand = NUM / STR / CHR / 'func' Signature Block / CompositeType Literal / '(' (Expr / Type) ')' / ConvType '(' Expr ','? ')' / NAME (TypeArgs? Literal)? ;
CompositeType = '[' ']' Type / '[' ('...' / Expr) ']' Type / 'map' '[' Type ']' Type / Struct ;
ConvType = '[' ']' Type / 'map' '[' Type ']' Type / ChanType / 'func' Signature / Interface / Struct ;
Suffix = '.' (NAME (TypeArgs? Literal)? / '(' ('type' / Type) ')') / '[' (Expr? ':' Expr? (':' Expr)? / (Expr / Type) (',' Type)* ','?) ']' / '(' (Arg (',' Arg)* '...'? ','?)? ')' ;
Arg = Expr / Type ;
Literal = '{' (Element (',' ~ Element)*)? ','? '}' ;
Element = (Literal / Expr) (':' (Literal / Expr))? ;
HeadExprs = HeadExpr (',' HeadExpr)* ;
HeadExpr = HeadUnary (BinaryOp HeadUnary)* ;
HeadUnary = ('+' / '-' / '!' / '^' / '*' / '&' / '<-') HeadUnary / HeadPrimary ;
HeadPrimary = (NUM / STR / CHR / 'func' Signature Block / CompositeType Literal / '(' (Expr / Type) ')' / ConvType '(' Expr ','? ')' / NAME) HeadSuffix* ;
HeadSuffix = '.' (NAME / '(' ('type' / Type) ')') / '[' (Expr? ':' Expr? (':' Expr)? / (Expr / Type) (',' Type)* ','?) ']' / '(' (Arg (',' Arg)* '...'? ','?)? ')' ;
"""

# {{...}} holds what only TypeScript has
JS_RULES = """
File = (Statement ~)* EOF ;
End = ';' / EOS ;
Statement = Block / ';' / Function / Class / Import / Export {{/ Interface / Alias / TsEnum / Namespace / Declare / AbstractClass }}/ Var End / If / For / While / Do / Try / Switch / 'with' '(' Exprs ')' Statement
  / 'return' (!EOS Exprs)? End / 'throw' Exprs End / 'break' (!EOS NAME)? End / 'continue' (!EOS NAME)? End / 'debugger' End / NAME ':' Statement / !('function' / 'class') Exprs End ;
Block = '{' Statement* '}' ;
Var = ('var' / 'const' / 'let' !('=' / '.' / '(' / ';') / 'using' &NAME) Declarator (',' Declarator)* ;
Declarator = Binding {{'!'? (':' Type)? }}('=' Assign)? ;
Binding = NAME / '[' (BindingItem? ',')* BindingItem? ']' / '{' (BindingProp (',' BindingProp)*)? ','? '}' ;
BindingItem = '...'? Binding ('=' Assign)? ;
BindingProp = '...' Binding / PropName ':' Binding ('=' Assign)? / NAME ('=' Assign)? ;
If = 'if' '(' Exprs ')' Statement ('else' Statement)? ;
While = 'while' '(' Exprs ')' Statement ;
Do = 'do' Statement 'while' '(' Exprs ')' ';'? ;
For = 'for' 'await'? '(' (ForVar ('of' Assign / 'in' Exprs) / (Var / Exprs)? ';' Exprs? ';' Exprs?) ')' Statement ;
ForVar = ('var' / 'const' / 'let') Binding / Unary ;
Try = 'try' Block (Catch Finally? / Finally) ;
Catch = 'catch' ('(' Binding {{(':' Type)? }}')')? Block ;
Finally = 'finally' Block ;
Switch = 'switch' '(' Exprs ')' '{' (('case' Exprs / 'default') ':' Statement*)* '}' ;
Function = 'async'? 'function' '*'? NAME? {{TypeParams? }}Params {{(':' ReturnType)? }}(Block {{/ End }}) ;
Params = '(' (Param (',' Param)*)? ','? ')' ;
Param = Decorator* {{Access* }}'...'? (Binding {{'?'? (':' Type)? / 'this' ':' Type}}) ('=' Assign)? ;
Decorator = '@' ('(' Exprs ')' / NAME ('.' WORD)* ('(' Args? ')')*) ;
Class = Decorator* 'class' NAME? {{TypeParams? }}('extends' LeftSide {{TypeArgs? }})? {{('implements' Types)? }}ClassBody ;
ClassBody = '{' (';' / Member ~)* '}' ;
Member = 'static' Block / Decorator* {{(Access / 'static' !(MemberEnd) / 'declare' &(WORD / '[' / STR))* }}('static' !MemberEnd)? {{Access* }}(Accessor / Method / {{IndexSig End / }}Property) ;
MemberEnd = '=' / ';' / '(' / '}' / ':' / '?' / EOF ;
Accessor = ('get' / 'set') PropName Params {{(':' ReturnType)? }}(Block {{/ End }}) ;
Method = ('async' !(MemberEnd / EOS))? '*'? PropName {{'?'? TypeParams? }}Params {{(':' ReturnType)? }}(Block {{/ End }}) ;
Property = ('accessor' &(WORD / STR / '['))? PropName {{('?' / '!')? (':' Type)? }}('=' Assign)? End ;
PropName = WORD / STR / NUM / '[' Assign ']' ;
Import = 'import' (STR / {{'type'? }}ImportClause 'from' STR{{ / NAME '=' Exprs }}) ImportWith? End ;
ImportWith = ('with' / 'assert') Object ;
ImportClause = NAME (',' (NameSpace / Named))? / NameSpace / Named ;
NameSpace = '*' 'as' NAME ;
Named = '{' (NamedItem (',' NamedItem)*)? ','? '}' ;
NamedItem = {{('type' &WORD)? }}(WORD / STR) ('as' (WORD / STR))? ;
Export = Decorator* 'export' ('default' (Function / Class / {{AbstractClass / Interface / }}Assign End) / {{'type'? }}'*' ('as' (WORD / STR))? 'from' STR ImportWith? End / {{'type'? }}Named ('from' STR ImportWith?)? End / {{'=' Exprs End / 'as' 'namespace' NAME End / Interface / Alias / TsEnum / Namespace / Declare / AbstractClass / Import / }}Function / Class / Var End) ;
Exprs = Assign (',' Assign)* ;
Assign = Arrow / Yield / Conditional (AssignOp Assign)? ;
AssignOp = '=' / '+=' / '-=' / '*=' / '/=' / '%=' / '**=' / '<<=' / '>' '>' '=' / '>' '>' '>' '=' / '&=' / '^=' / '|=' / '&&=' / '||=' / '??=' ;
Yield = 'yield' (!EOS '*'? Assign)? ;
Arrow = ('async' !EOS)? (NAME / {{TypeParams? }}Params {{(':' ReturnType)? }}) '=>' (Block / Assign) ;
Conditional = Binary ('?' Assign ':' Assign)? ;
Binary = Unary (BinaryOp Unary{{ / !EOS ('as' / 'satisfies') Type }})* ;
BinaryOp = '??' / '||' / '&&' / '|' / '^' / '&' / '===' / '!==' / '==' / '!=' / '<=' / '<<' / '<' / '>' '>' '>' !'=' / '>' '>' !'=' / '>' '=' / '>' !'>' / 'instanceof' / 'in' / '+' / '-' / '**' / '*' / '/' / '%' ;
Unary = ('delete' / 'void' / 'typeof' / '+' / '-' / '~' / '!' / '++' / '--' / 'await' !('=' / ',' / ')' / ';' / '.')) Unary / {{TypeArgs Unary / }}Postfix ;
Postfix = LeftSide (!EOS ('++' / '--'))? ;
LeftSide = ('new' New / Primary) Suffix* ;
New = '.' WORD / ('new' New / Primary) NewSuffix* {{TypeArgs? }}('(' Args? ')')? ;
NewSuffix = '.' WORD / '[' Exprs ']' / Template ;
Suffix = '?.' ('(' Args? ')' / '[' Exprs ']' / WORD) / '.' WORD / '[' Exprs ']' / '(' Args? ')' / Template {{/ TypeArgs &('(' / TPL / TPLH) / !EOS '!' !'=' }};
Args = Arg (',' Arg)* ','? ;
Arg = '...'? Assign ;
Template = TPL / TPLH Exprs (TPLM Exprs)* TPLT ;
Primary = 'this' / 'super' / NUM / STR / REGEX / Template / 'null' / 'true' / 'false' / 'import' ('.' WORD / &'(') / '(' Exprs ')' / Array / Object / Function / Class / NAME ;
Array = '[' (Arg? ',' ~)* Arg? ']' ;
Object = '{' (ObjectItem (',' ObjectItem)*)? ','? '}' ;
ObjectItem = '...' Assign / Accessor / PropName ':' Assign / ('async' !(',' / ':' / '(' / '}' / '='))? '*'? PropName {{TypeParams? }}Params {{(':' ReturnType)? }}Block / NAME ('=' Assign)? ;
"""
TS_RULES = """
Access = ('public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override') &(WORD / '[' / STR / '{' / '*') ;
AbstractClass = 'abstract' Class ;
Interface = 'interface' NAME TypeParams? ('extends' Types)? ObjectType ;
Alias = 'type' NAME TypeParams? '=' Type End ;
TsEnum = 'const'? 'enum' NAME '{' (EnumItem (',' EnumItem)*)? ','? '}' ;
EnumItem = (WORD / STR) ('=' Assign)? ;
Namespace = ('namespace' / 'module') (NAME ('.' NAME)* / STR) Block ;
Declare = 'declare' ('global' Block / 'module' STR End / Function / Class / Interface / Alias / TsEnum / Namespace / AbstractClass / Var End) ;
TypeParams = '<' TypeParam (',' TypeParam)* ','? '>' ;
TypeParam = ('const' / 'in' / 'out')* NAME ('extends' Type)? ('=' Type)? ;
TypeArgs = '<' Type (',' Type)* '>' ;
Types = Type (',' Type)* ;
ReturnType = 'asserts'? (NAME / 'this') 'is' Type / 'asserts' NAME / Type ;
Type = FunctionType / Union ('extends' Union '?' Type ':' Type)? ;
FunctionType = ('abstract'? 'new')? TypeParams? Params '=>' ReturnType ;
Union = ('|' / '&')? Operator (('|' / '&') Operator)* ;
Operator = ('keyof' / 'unique' / 'readonly') Operator / 'infer' NAME ('extends' Union !'?')? / TypeAtom (!EOS '[' Type? ']')* ;
TypeAtom = '(' Type ')' / ObjectType / Tuple / STR / '-'? NUM / TPL / TPLH Type (TPLM Type)* TPLT / 'typeof' (NAME / 'this' / 'import' '(' STR ')') ('.' WORD)* TypeArgs? / 'import' '(' STR ')' ('.' WORD)* TypeArgs? / 'this' / 'void' / 'null' / 'true' / 'false' / NAME ('.' WORD)* TypeArgs? ;
Tuple = '[' (TupleItem (',' TupleItem)*)? ','? ']' ;
TupleItem = '...'? (NAME '?'? ':' Type / Type '?'?) ;
ObjectType = '{' (Mapped / (TypeMember (';' / ',' / EOS))*) '}' ;
Mapped = (('+' / '-')? 'readonly')? '[' NAME 'in' Type ('as' Type)? ']' (('+' / '-')? '?')? (':' Type)? ';'? ;
TypeMember = 'new'? TypeParams? Params (':' ReturnType)? / 'readonly'? IndexSig / ('get' / 'set') PropName Params (':' ReturnType)? / ('readonly' !(':' / '?' / '('))? PropName '?'? (TypeParams? Params (':' ReturnType)? / (':' Type)?) ;
IndexSig = '[' NAME ':' Type ']' ':' Type ;
"""

SQL_RULES = """
File = (';' / Go / Statement (';' / Go / &EOF) ~ / Batch &Begins ~)* EOF ;
Begins = 'SELECT' / 'INSERT' / 'UPDATE' / 'DELETE' / 'CREATE' / 'ALTER' / 'DROP' / 'TRUNCATE' / 'MERGE' / 'GRANT' / 'REVOKE' / 'SET' / 'DECLARE' / 'EXEC' / 'EXECUTE' / 'PRINT' / 'IF' / 'BEGIN' / 'WITH' / 'USE' / 'COMMENT' 'ON' ;
Batch = Set / Declare / If / Block / ('EXEC' / 'EXECUTE' / 'PRINT' / 'USE') Soup ;
Go = 'GO' NUM? / '/' ;
Statement = Query / Insert / Update / Delete / Merge / CreateTable / CreateView / CreateIndex / Routine / CreateOther / Alter / Drop / Block / Command ;
Name = NAME / QID ;
Path = Name ('.' Name)* ;
Names = '(' Name (',' Name)* ')' ;
Query = With? (QueryTerm (('UNION' / 'INTERSECT' / 'EXCEPT' / 'MINUS') ('ALL' / 'DISTINCT')? QueryTerm)* OrderBy? Limit* / Insert / Update / Delete) ;
With = 'WITH' 'RECURSIVE'? Cte (',' Cte)* ;
Cte = Name Names? 'AS' ('NOT'? 'MATERIALIZED')? '(' Query ')' ;
QueryTerm = Select / '(' Query ')' / Values ;
Select = 'SELECT' ('ALL' / 'DISTINCT' ('ON' '(' Exprs ')')? / 'TOP' (NUM / '(' Expr ')') 'PERCENT'?)* SelectItem (',' SelectItem)* ('INTO' IntoTarget)? ('FROM' Sources)? ('WHERE' Expr)? GroupBy? ('HAVING' Expr)? ('WINDOW' Name 'AS' Over (',' Name 'AS' Over)*)? ('QUALIFY' Expr)? ;
IntoTarget = 'STRICT'? Path (',' Path)* ;
SelectItem = '*' / Path '.' '*' / Expr ('AS' (Name / STR) / Name / STR)? ;
Sources = Source (',' Source)* ;
Source = SourceAtom (Join)* ;
Join = ('NATURAL' / 'INNER' / ('LEFT' / 'RIGHT' / 'FULL') 'OUTER'? / 'CROSS')* ('JOIN' / 'APPLY') SourceAtom ('ON' Expr / 'USING' Names)? ;
SourceAtom = 'LATERAL'? ('(' (Query / Source) ')' / Path ('(' Exprs? ')')? / 'UNNEST' '(' Exprs ')') ('AS'? Name Names?)? ('WITH' '(' Name (',' Name)* ')')? ;
GroupBy = 'GROUP' 'BY' ('ALL' / Exprs) ('WITH' 'ROLLUP')? ;
OrderBy = 'ORDER' 'BY' OrderItem (',' OrderItem)* ;
OrderItem = Expr ('ASC' / 'DESC')? ('NULLS' ('FIRST' / 'LAST'))? ;
Limit = 'LIMIT' Expr (',' Expr)? / 'OFFSET' Expr ('ROW' / 'ROWS')? / 'FETCH' ('FIRST' / 'NEXT') Expr? ('ROW' / 'ROWS') ('ONLY' / 'WITH' 'TIES') / 'FOR' ('UPDATE' / 'SHARE') ('OF' Path)? ('NOWAIT' / 'SKIP' 'LOCKED')? ;
Values = 'VALUES' 'ROW'? Tuple (',' 'ROW'? Tuple ~)* ;
Tuple = '(' (('DEFAULT' / Expr) (',' ('DEFAULT' / Expr))*)? ')' ;
Insert = ('INSERT' ('IGNORE' / 'OR' ('REPLACE' / 'IGNORE'))? 'INTO'? / 'REPLACE' 'INTO') 'TABLE'? Path ('AS' Name)? Names? ('OVERRIDING' ('SYSTEM' / 'USER') 'VALUE')? (Values / Query / 'DEFAULT' 'VALUES' / 'SET' Sets / ('EXEC' / 'EXECUTE') Soup) OnConflict? Returning? ;
OnConflict = 'ON' 'CONFLICT' (Names / 'ON' 'CONSTRAINT' Name)? ('WHERE' Expr)? 'DO' ('NOTHING' / 'UPDATE' 'SET' Sets ('WHERE' Expr)?) / 'ON' 'DUPLICATE' 'KEY' 'UPDATE' Sets ;
Returning = 'RETURNING' SelectItem (',' SelectItem)* ('INTO' IntoTarget)? ;
Sets = SetItem (',' SetItem)* ;
SetItem = (Path / Names) ('=' / ':=') ('DEFAULT' / Expr) ;
Update = 'UPDATE' ('ONLY' / 'TOP' '(' Expr ')')? Source 'SET' Sets ('FROM' Sources)? ('WHERE' ('CURRENT' 'OF' Name / Expr))? OrderBy? Limit* Returning? ;
Delete = 'DELETE' 'FROM'? 'ONLY'? Path ('AS'? Name)? ('FROM' Sources)? ('USING' Sources)? ('WHERE' ('CURRENT' 'OF' Name / Expr))? OrderBy? Limit* Returning? ;
Merge = 'MERGE' 'INTO'? Path ('AS'? Name)? 'USING' SourceAtom 'ON' Expr ('WHEN' 'NOT'? 'MATCHED' ('BY' Name)? ('AND' Expr)? 'THEN' ('UPDATE' 'SET' Sets / 'DELETE' / 'DO' 'NOTHING' / 'INSERT' Names? (Values / 'DEFAULT' 'VALUES')))+ ;
CreateHead = 'CREATE' ('OR' ('REPLACE' / 'ALTER'))? ('GLOBAL' / 'LOCAL')? ('TEMPORARY' / 'TEMP' / 'UNLOGGED' / 'EXTERNAL')? ;
IfNot = 'IF' 'NOT' 'EXISTS' ;
CreateTable = CreateHead 'TABLE' IfNot? Path ('(' TableItem (',' TableItem)* ')' TableOption* ('AS'? Query)? / TableOption* 'AS' Query / 'LIKE' Path) ;
TableItem = TableConstraint / 'LIKE' Path (Name Name)* / !('CONSTRAINT' / 'PRIMARY' / 'FOREIGN' / 'UNIQUE' / 'CHECK') Name DataType? ColumnOption* ;
DataType = ('DOUBLE' 'PRECISION' / ('CHARACTER' / 'NATIONAL')+ 'VARYING'? / 'ENUM' / 'SET' / Path) ('(' (NUM / STR / Name) (',' (NUM / STR / Name))* Name? ')')? ('UNSIGNED' / 'ZEROFILL' / 'VARYING' ('(' NUM ')')? / ('WITH' / 'WITHOUT') 'LOCAL'? 'TIME' 'ZONE' / 'ARRAY' / '[' NUM? ']' / '%' ('TYPE' / 'ROWTYPE'))* ;
ColumnOption = 'NOT' 'NULL' / 'NULL' / 'DEFAULT' Bin / 'PRIMARY' 'KEY' ('CLUSTERED' / 'NONCLUSTERED')? ('ASC' / 'DESC')? / 'UNIQUE' 'KEY'? / 'KEY' / 'CHECK' '(' Expr ')' / References / 'AUTO_INCREMENT' / 'AUTOINCREMENT' / 'IDENTITY' ('(' NUM ',' NUM ')')? / 'GENERATED' ('ALWAYS' / 'BY' 'DEFAULT') 'AS' ('IDENTITY' ('(' Soup ')')? / '(' Expr ')') ('STORED' / 'VIRTUAL')? / 'AS' '(' Expr ')' 'PERSISTED'? / 'COMMENT' STR / 'COLLATE' (Name / STR) / 'CHARACTER' 'SET' Name / 'ON' 'UPDATE' Bin / 'CONSTRAINT' Name / 'ENCODE' Name / 'ROWGUIDCOL' / 'SPARSE' ;
References = 'REFERENCES' Path Names? ('ON' ('DELETE' / 'UPDATE') ('CASCADE' / 'RESTRICT' / 'NO' 'ACTION' / 'SET' ('NULL' / 'DEFAULT')) / 'MATCH' Name / 'NOT'? 'DEFERRABLE' / 'INITIALLY' Name)* ;
TableConstraint = ('CONSTRAINT' Name)? ('PRIMARY' 'KEY' ('CLUSTERED' / 'NONCLUSTERED')? KeyCols / 'UNIQUE' ('KEY' / 'INDEX')? Name? KeyCols / ('KEY' / 'INDEX') Name? KeyCols / 'FOREIGN' 'KEY' Name? Names References / 'CHECK' '(' Expr ')' / 'EXCLUDE' Soup) ('USING' Name)? ;
KeyCols = '(' KeyCol (',' KeyCol)* ')' ;
KeyCol = Expr ('ASC' / 'DESC')? ('NULLS' ('FIRST' / 'LAST'))? ;
TableOption = 'ENGINE' '='? Name / 'DEFAULT'? ('CHARSET' / 'CHARACTER' 'SET' / 'COLLATE') '='? (Name / STR) / 'COMMENT' '='? STR / 'AUTO_INCREMENT' '='? NUM / 'ROW_FORMAT' '='? Name / 'TABLESPACE' Name / 'INHERITS' Names / 'PARTITION' 'BY' Name '(' Exprs ')' / 'WITH' '(' Soup ')' / 'ON' Name / 'WITHOUT' 'ROWID' / 'STRICT' / 'STORED' 'AS' Name / 'USING' Name / 'LOCATION' STR / ',' ;
CreateView = CreateHead ('MATERIALIZED' / 'SECURE' / 'FORCE')* 'VIEW' IfNot? Path Names? ('WITH' Name (',' Name)*)? 'AS' Query ('WITH' ('LOCAL' / 'CASCADED')? 'CHECK' 'OPTION' / 'WITH' 'NO'? 'DATA')? ;
CreateIndex = CreateHead ('UNIQUE' / 'CLUSTERED' / 'NONCLUSTERED' / 'FULLTEXT')* 'INDEX' 'CONCURRENTLY'? IfNot? Path? 'ON' Path ('USING' Name)? KeyCols ('INCLUDE' Names)? ('WITH' '(' Soup ')')? ('WHERE' Expr)? ;
CreateOther = CreateHead (('SCHEMA' / 'DATABASE') IfNot? (Path ('AUTHORIZATION' Path)? / 'AUTHORIZATION' Path) Soup? Statement* / 'SEQUENCE' IfNot? Path ('AS' DataType)? SequenceOption* / 'TYPE' IfNot? Path TypeBody? / 'DOMAIN' Path 'AS'? DataType ('CONSTRAINT' Name / 'NOT' 'NULL' / 'NULL' / 'DEFAULT' Bin / 'COLLATE' Path / 'CHECK' '(' Expr ')')*
  / ('ROLE' / 'USER' / 'LOGIN') IfNot? Account (',' Account)* RoleOption* / 'POLICY' Name 'ON' Path PolicyPart* / ('EXTENSION' / 'SYNONYM') IfNot? Path Soup?) ;
SequenceOption = 'INCREMENT' 'BY'? Signed / ('MINVALUE' / 'MAXVALUE' / 'CACHE') Signed / 'START' 'WITH'? Signed / 'RESTART' ('WITH'? Signed)? / 'NO' ('MINVALUE' / 'MAXVALUE' / 'CYCLE' / 'CACHE' / 'ORDER') / 'CYCLE' / 'NOCYCLE' / 'NOCACHE' / 'NOMINVALUE' / 'NOMAXVALUE' / 'ORDER' / 'NOORDER' / 'OWNED' 'BY' Path ;
Signed = ('+' / '-')? (NUM / PAR) ;
TypeBody = ('AS' / 'IS') ('ENUM' '(' (STR (',' STR)*)? ')' / 'RANGE' '(' Soup ')' / 'OBJECT'? '(' (TableItem (',' TableItem)*)? ')' / 'TABLE' ('OF' DataType / '(' TableItem (',' TableItem)* ')') / ('VARRAY' / 'VARYING' 'ARRAY') '(' NUM ')' 'OF' DataType) / 'FROM' DataType ('NOT'? 'NULL')? / 'UNDER' Path '(' TableItem (',' TableItem)* ')' / '(' Soup ')' ;
Account = (Path / STR) ('@' (Name / STR))? ;
RoleOption = 'IDENTIFIED' ('WITH' (Name / STR))? ('BY' / 'AS') 'PASSWORD'? (STR / Name) / 'IDENTIFIED' ('WITH' (Name / STR) / 'EXTERNALLY') / ('ENCRYPTED' / 'UNENCRYPTED')? 'PASSWORD' '='? (STR / 'NULL' / NUM / PAR) 'HASHED'? 'MUST_CHANGE'? / 'VALID' 'UNTIL' STR / 'CONNECTION' 'LIMIT' Signed / 'IN' ('ROLE' / 'GROUP' / 'DATABASE') Paths / ('ROLE' / 'ADMIN' / 'USER') Paths / 'DEFAULT' ('ROLE' / 'TABLESPACE') Paths / 'TEMPORARY' 'TABLESPACE' Name / 'QUOTA' (NUM Name? / 'UNLIMITED') 'ON' Name / 'PROFILE' Name / 'ACCOUNT' ('LOCK' / 'UNLOCK') / 'SYSID' NUM / ('FOR' / 'FROM') ('LOGIN' / 'CERTIFICATE') Name / 'WITHOUT' 'LOGIN' / 'AUTHORIZATION' Name / 'REQUIRE' ('SSL' / 'X509' / 'NONE') / 'COMMENT' '='? STR
  / 'SUPERUSER' / 'NOSUPERUSER' / 'CREATEDB' / 'NOCREATEDB' / 'CREATEROLE' / 'NOCREATEROLE' / 'INHERIT' / 'NOINHERIT' / 'LOGIN' / 'NOLOGIN' / 'REPLICATION' / 'NOREPLICATION' / 'BYPASSRLS' / 'NOBYPASSRLS' / 'WITH' RoleOption / ',' RoleOption / Name '=' (Name / STR / NUM / 'DEFAULT' / 'ON') ;
Paths = Path (',' Path)* ;
PolicyPart = 'AS' ('PERMISSIVE' / 'RESTRICTIVE') / 'FOR' ('ALL' / 'SELECT' / 'INSERT' / 'UPDATE' / 'DELETE') / 'TO' Paths / 'USING' '(' Expr ')' / 'WITH' 'CHECK' '(' Expr ')' ;
Alter = 'ALTER' ('TABLE' 'ONLY'? ('IF' 'EXISTS')? Path AlterItem (',' AlterItem)* / ('ROLE' / 'USER' / 'LOGIN') ('IF' 'EXISTS')? Account (('RENAME' 'TO' Name / ('IN' 'DATABASE' Name)? (Set / 'RESET' Name) / 'ENABLE' / 'DISABLE') / RoleOption+) / 'SEQUENCE' ('IF' 'EXISTS')? Path (SequenceOption+ / AlterTail)
  / 'TYPE' Path ('ADD' 'VALUE' IfNot? STR (('BEFORE' / 'AFTER') STR)? / 'RENAME' 'VALUE' STR 'TO' STR / ('ADD' / 'DROP' / 'ALTER') 'ATTRIBUTE' Soup / AlterTail) / ('SESSION' / 'SYSTEM') Soup / 'DEFAULT' 'PRIVILEGES' ('FOR' ('ROLE' / 'USER') Paths)? ('IN' 'SCHEMA' Paths)? Grant / 'POLICY' Name 'ON' Path (PolicyPart+ / 'RENAME' 'TO' Name) / ('VIEW' / 'PROCEDURE' / 'PROC' / 'FUNCTION' / 'TRIGGER') (Path Names? 'AS' Query / RoutineBody / Path ('(' Soup? ')')? (AlterTail / Soup)) / !('TABLE' / 'ROLE' / 'USER' / 'LOGIN' / 'SEQUENCE' / 'TYPE' / 'VIEW' / 'SESSION' / 'SYSTEM') Name Path ('(' Soup? ')')? (AlterTail / Soup)) ;
AlterTail = 'RENAME' ('TO' Path / Soup) / 'OWNER' 'TO' Path / 'SET' 'SCHEMA' Name / 'SET' Soup ;
AlterItem = 'ADD' (TableConstraint / 'COLUMN'? IfNot? '('? TableItem (',' TableItem)* ')'?) / 'DROP' ('COLUMN' / 'CONSTRAINT' / 'PRIMARY' 'KEY' / 'FOREIGN' 'KEY' / 'INDEX')? ('IF' 'EXISTS')? Name? ('CASCADE' / 'RESTRICT')? / 'RENAME' ('TO' Path / 'COLUMN'? Name 'TO' Name) / ('MODIFY' / 'CHANGE') 'COLUMN'? Name? TableItem / 'ALTER' 'COLUMN'? Name ('TYPE' DataType ('USING' Expr)? / 'SET' ('DEFAULT' Expr / 'NOT' 'NULL' / 'DATA' 'TYPE' DataType) / 'DROP' ('DEFAULT' / 'NOT' 'NULL') / DataType ColumnOption*) / ('OWNER' 'TO' / 'SET' / 'ENABLE' / 'DISABLE' / 'ENGINE' / 'COMMENT') Soup ;
Drop = 'DROP' ('MATERIALIZED' / 'TEMPORARY')? Name 'CONCURRENTLY'? ('IF' 'EXISTS')? Path (',' Path)* ('(' Soup? ')')? ('ON' Path)? ('CASCADE' / 'RESTRICT' / 'CONSTRAINTS' / 'PURGE')* / 'TRUNCATE' 'TABLE'? Path (',' Path)* ('CASCADE' / 'RESTRICT' / 'RESTART' 'IDENTITY')* ;
Routine = CreateHead ('DEFINER' '=' (Name / STR) ('@' (Name / STR))?)? ('PROCEDURE' / 'PROC' / 'FUNCTION' / 'TRIGGER' / 'EVENT' / 'PACKAGE' 'BODY'?) RoutineBody ;
RoutineBody = IfNot? Path (!('BEGIN' / 'AS' / 'IS' / DOLLAR / ';') Any)* (('AS' / 'IS')? (DOLLAR / STR / Declares? Block / Simple / Query / Insert / Update / Delete) RoutineTail* / 'RETURN' Expr) ;
RoutineTail = 'LANGUAGE' (Name / STR) / 'IMMUTABLE' / 'STABLE' / 'VOLATILE' / 'STRICT' / 'SECURITY' Name / 'COST' NUM ;
Any = '(' Soup? ')' / WORD / QID / NUM / STR / PAR / ',' / '=' / '.' / '%' / ':=' / '[' / ']' / '*' / '-' ;
Declares = 'DECLARE'? (Name ('CONSTANT')? ('CURSOR' ('FOR' / 'IS') Query / DataType ('NOT' 'NULL')? ((':=' / '=' / 'DEFAULT') Expr)?) ';')+ ;
Block = Declares? 'BEGIN' ('TRANSACTION' / 'TRAN' / 'ATOMIC' / 'TRY' / 'CATCH')* (Inner ~)* ('EXCEPTION' ('WHEN' Expr 'THEN' Inner*)+)? 'END' ('TRY' / 'CATCH' / Name !'=')? ;
Inner = ';' / If / Loop / 'RETURN' ('NEXT' / 'QUERY')? (Query / Expr)? / Perform / Raise / Declare / Block / Statement ;
Perform = ('PERFORM' / 'CALL' / 'EXECUTE' / 'EXEC' / 'PRINT' / 'OPEN' / 'CLOSE' / 'FETCH' / 'LEAVE' / 'ITERATE' / 'EXIT' / 'CONTINUE' / 'BREAK' / 'NULL' / 'COMMIT' / 'ROLLBACK' / 'SIGNAL' / 'THROW') Soup? &(';' / 'END' / EOF) ;
Raise = ('RAISE' / 'RAISERROR') Soup? ;
Declare = 'DECLARE' (('CONTINUE' / 'EXIT' / 'UNDO') 'HANDLER' 'FOR' Soup Inner / Name ('INSENSITIVE' / 'SCROLL' / 'NO' 'SCROLL')* 'CURSOR' (!'FOR' Name)* 'FOR' Query / Name 'CONDITION' 'FOR' Soup / DeclareItem (',' DeclareItem)*) ;
DeclareItem = Name (',' Name)* 'AS'? ('TABLE' '(' TableItem (',' TableItem)* ')' / 'CURSOR' / DataType) ('NOT' 'NULL')? (('=' / ':=' / 'DEFAULT') Expr)? ;
If = 'IF' Expr ('THEN' Inner* (('ELSIF' / 'ELSEIF') Expr 'THEN' Inner*)* ('ELSE' Inner*)? 'END' 'IF' / Inner ';'? ('ELSE' Inner)?) ;
Loop = ('WHILE' Expr / 'FOR' Name 'IN' 'REVERSE'? (Expr ('.' '.' Expr)? / Query))? 'LOOP' Inner* 'END' 'LOOP' Name? / 'WHILE' Expr ('DO' Inner* 'END' 'WHILE' / Inner) / 'REPEAT' Inner* 'UNTIL' Expr 'END' 'REPEAT' ;
Simple = If / Loop / Perform / Raise ;
Command = Set / Grant / 'COMMENT' 'ON' ('MATERIALIZED' / 'FOREIGN')? (Name Path ('(' Soup? ')')? / ('CONSTRAINT' / 'TRIGGER' / 'POLICY' / 'RULE') Name 'ON' 'DOMAIN'? Path) ('IS' (STR / 'NULL' / DOLLAR)) / If / Declare / 'COPY' (Path Names? / '(' Query ')') ('FROM' / 'TO') (STR / PAR / Name / 'PROGRAM' STR) Soup? / 'EXPLAIN' ('ANALYZE' / 'VERBOSE' / 'PLAN' 'FOR' / 'FORMAT' '='? Name / '(' Soup ')')* (Statement / Path)
  / ('USE' / 'SAVEPOINT' / 'CALL' / 'EXEC' / 'EXECUTE' / 'SHOW' / 'DESCRIBE' / 'LOCK' / 'UNLOCK' / 'DO' / 'REFRESH' / 'START' / 'PRINT' / 'LOAD') Soup / 'PRAGMA' Path ('=' ('ON' / Expr) / '(' Expr ')')? / ('COMMIT' / 'ROLLBACK' / 'DELIMITER' / 'ANALYZE' / 'VACUUM' / 'REINDEX' / 'CLUSTER' / 'BEGIN') Soup? / 'BEGIN' ('TRANSACTION' / 'WORK')? / 'END' ('TRANSACTION' / 'WORK')? ;
Set = 'SET' ('TRANSACTION' / 'SESSION' 'CHARACTERISTICS' 'AS' 'TRANSACTION') ('ISOLATION' 'LEVEL' Name Name? / 'READ' ('ONLY' / 'WRITE') / ',')+ / 'SET' 'CONSTRAINTS' ('ALL' / Paths) ('DEFERRED' / 'IMMEDIATE') / 'SET' ('SESSION' / 'LOCAL' / 'GLOBAL')? (('ROLE' / 'NAMES' / 'SCHEMA' / 'PASSWORD' / 'AUTHORIZATION') '='? SetValue ('COLLATE' (Name / STR))? / 'CHARACTER' 'SET' SetValue / 'TIME' 'ZONE' SetValue / 'IDENTITY_INSERT' Path ('ON' / 'OFF') / SetOne (',' SetOne)* / Name (',' Name)* ('ON' / 'OFF') / Name (SetValue (',' SetValue)*)) ;
SetOne = ('SESSION' / 'GLOBAL' / 'LOCAL' / 'PERSIST')? Path ('=' / ':=' / 'TO' / ('+' / '-' / '*' / '/' / '%' / '&' / '|' / '^') '=') SetValue (',' SetValue !('=' / ':=' / 'TO' / '.'))* ;
SetValue = 'ON' / 'DEFAULT' / 'CURSOR' 'FOR' Query / Expr ;
Grant = ('GRANT' / 'REVOKE' (('GRANT' / 'ADMIN') 'OPTION' 'FOR')? / 'DENY') Privilege (',' Privilege)* ('ON' (('ALL' Name 'IN' 'SCHEMA' / ('TABLE' / 'SEQUENCE' / 'SCHEMA' / 'DATABASE' / 'FUNCTION' / 'PROCEDURE' / 'TYPE' / 'DOMAIN' / 'LANGUAGE' / 'OBJECT') (':' ':' / '::')?)? GrantOn (',' GrantOn)*))? ('TO' / 'FROM') Grantee (',' Grantee)* ('WITH' ('GRANT' / 'ADMIN') 'OPTION' / 'GRANTED' 'BY' Path / 'CASCADE' / 'RESTRICT' / RoleOption)* ;
Privilege = (!('ON' / 'TO' / 'FROM') (Path / 'SELECT' / 'INSERT' / 'UPDATE' / 'DELETE' / 'REFERENCES' / 'CREATE' / 'ALL' / 'WITH' / 'SET'))+ Names? ;
GrantOn = ('*' / Path) ('.' '*')? ('(' Soup? ')')? ;
Grantee = ('GROUP' / 'ROLE' / 'USER')? Account / 'PUBLIC' ;
Soup = SoupPart (('=' / ':=' / '=>' / ',' / '-' / ':' / '.' / '@' / '%')? SoupPart / '*')* ;
SoupPart = !(SoupStop) (SoupLink (Query / SoupPart / '*') / '(' Soup? ')' / '[' Soup? ']' / Expr / SoupWord / QID / DOLLAR / '*' / '@' SoupPart) ;
SoupStop = 'SELECT' / 'INSERT' / 'UPDATE' / 'DELETE' / 'CREATE' / 'ALTER' (NAME / 'TABLE') / 'DROP' / 'TRUNCATE' / 'MERGE' / 'GRANT' / 'REVOKE' / 'DECLARE' / 'PRINT' / 'BEGIN' / 'END' / 'THEN' / 'ELSE' / 'COMMENT' 'ON' ;
SoupLink = 'ON' !('COMMIT' / 'DELETE') / 'TO' / 'FROM' / 'AS' / 'IS' / 'IN' / 'FOR' / 'BY' / 'USING' / 'WHERE' / 'AND' / 'OR' / 'INTO' / 'LIKE' / 'WHEN' / 'WITH' / 'NOT' / 'JOIN' / 'HAVING' / 'SET' / 'OF' / 'IF' / 'REFERENCES' / 'LEFT' / 'RIGHT' / 'FULL' / 'INNER' / 'CROSS' / 'GROUP' &'BY' / 'ORDER' &'BY' / 'LIMIT' / 'OFFSET' ;
SoupWord = 'EXISTS' / 'DISTINCT' / 'DEFAULT' / 'NULL' / 'PRIMARY' / 'FOREIGN' / 'UNIQUE' / 'CHECK' / 'CONSTRAINT' / 'VALUES' / 'GROUP' / 'ORDER' / 'FETCH' / 'WINDOW' ;
Exprs = Expr (',' Expr)* ;
Expr = Not (('OR' / 'AND' / 'XOR' / '&&' ) Not)* ;
Not = 'NOT' Not / Compare ;
Compare = Bin ('NOT'? ('LIKE' / 'ILIKE' / 'RLIKE' / 'REGEXP' / 'SIMILAR' 'TO') Bin ('ESCAPE' STR)? / 'NOT'? 'BETWEEN' Bin 'AND' Bin / 'NOT'? 'IN' ('(' (Query / Exprs) ')' / Bin) / 'IS' 'NOT'? ('NULL' / 'TRUE' / 'FALSE' / 'DISTINCT' 'FROM' Bin) / ('=' / '<>' / '!=' / '<=>' / '<=' / '>=' / '<' / '>' / '~' '*'? / '!' '~' '*'?) ('ALL' / 'ANY' / 'SOME')? Bin / 'ISNULL' / 'NOTNULL')* ;
Bin = Unary (('+' / '-' / '*' / '/' / '%' / '||' / '|' / '&' / '^' / '->' / '->>' / 'DIV' / 'MOD' / 'COLLATE' / 'AT' 'TIME' 'ZONE') Unary)* ;
Unary = ('+' / '-' / '~') Unary / 'PRIOR' Unary / Atom ('::' DataType / '[' Expr (':' Expr)? ']' / '.' Name)* ;
Atom = NUM / STR / PAR / DOLLAR / 'NULL' / 'DEFAULT' / '*' / Case / 'NOT'? 'EXISTS' '(' Query ')' / 'CAST' '(' Expr 'AS' DataType ')' / 'INTERVAL' (STR / NUM / Expr) Name? / 'ARRAY' '[' Exprs? ']' / ('DATE' / 'TIMESTAMP' / 'TIME') STR / '(' (Query / Exprs)? ')' / 'EXTRACT' '(' Name 'FROM' Expr ')' / ('LEFT' / 'RIGHT' / 'VALUES' / 'SET') '(' Exprs ')' / Call / Path ;
Call = Path '(' (('DISTINCT' / 'ALL')? CallArg ((',' / 'FROM' / 'FOR' / 'AS' / 'USING' / 'SEPARATOR' / 'IN') CallArg)* OrderBy?)? ')' ('WITHIN' 'GROUP' '(' OrderBy ')')? ('FILTER' '(' 'WHERE' Expr ')')? ('OVER' (Over / Name))? ;
CallArg = Query / Name '=>' Expr / Expr Name? ;
Over = '(' (!('PARTITION' 'BY' / 'ROWS' / 'RANGE' / 'GROUPS') Name)? ('PARTITION' 'BY' Exprs)? OrderBy? (('ROWS' / 'RANGE' / 'GROUPS') (!')' Any / 'BETWEEN' / 'AND')+)? ')' ;
Case = 'CASE' Expr? ('WHEN' Expr 'THEN' Expr)+ ('ELSE' Expr)? 'END' ;
"""


def _js(ts: bool) -> str:
    rules = re.sub(r"\{\{(.*?)\}\}", r"\1" if ts else "", JS_RULES, flags=re.S)
    rules = rules.replace("(Block / End )", "(Block / End)").replace("(Block )", "Block")
    return rules + (TS_RULES if ts else "")


@cache
def grammar(language: str) -> Grammar:
    return {
        "json": lambda: Grammar(JSON_RULES, {"true", "false", "null"}, "File"),
        "xml": lambda: Grammar(XML_RULES, set(), "File"),
        "python": lambda: Grammar(PYTHON_RULES, PYTHON_WORDS, "File"),
        "java": lambda: Grammar(JAVA_RULES, JAVA_WORDS, "File"),
        "go": lambda: Grammar(GO_RULES, GO_WORDS, "File"),
        "javascript": lambda: Grammar(_js(False), JS_WORDS, "File"),
        "typescript": lambda: Grammar(_js(True), JS_WORDS, "File"),
        "sql": lambda: Grammar(SQL_RULES, SQL_WORDS, "File"),
    }[language]()


LEXERS = {
    "json": lambda s: lex(_JSON_LEX, s.removeprefix("\ufeff"), {"true", "false", "null"}),
    "xml": lex_xml,
    "python": lex_python,
    "java": lambda s: lex(_JAVA_LEX, s, JAVA_WORDS),
    "go": lex_go,
    "javascript": lex_js,
    "typescript": lex_js,
    "sql": lambda s: lex(_SQL_LEX, s, SQL_WORDS, upper=True),
}


def failure(language: str, text: str) -> int:
    """0 if the whole text is valid in the language, else the line of the furthest failure."""
    tokens = LEXERS[language](text)
    at = grammar(language).parse(tokens)
    if at < 0:
        return 0
    return tokens.line[at] if at < len(tokens.line) else max(1, text.count("\n") + 1)
