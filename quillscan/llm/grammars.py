"""Grammars of problem 7: json, js, ts, java, go, rb and py."""

from __future__ import annotations

from collections.abc import Iterator

import regex

from quillscan.llm.peg import Grammar, Moved

def _plain(name: str, string: str, call: str, operator: str, depth: int = 3) -> str:
    """The pattern of an expression of names, numbers, strings, operators and calls up to ``depth``."""
    atom = rf"(?>{name}|(?>0|[1-9]\d*+)(?![\w.])|{string})"
    e = rf"{atom}(?> ?{operator} ?{atom})*+"
    for _ in range(depth):
        e = rf"(?>{call}\((?>{e}(?>, ?{e})*+)?+\)(?! ?[\w({{\[.?])|{e})"
    return e


JSON = Grammar(
    r"""
File <- Value EOF
EOF <- ~/\Z/
Value <- STRING / NUMBER / WORD / Object / Array
Object <- '{' (Pair (',' Pair)*)? '}'
Pair <- STRING ':' Value
Array <- '[' (Value (',' Value)*)? ']'
STRING <- /"(?>[^"\\\x00-\x1f]++|\\(?>["\\\/bfnrt]|u[0-9a-fA-F]{4}))*+"/
NUMBER <- /-?(?>0|[1-9]\d*+)(?>\.\d++)?+(?>[eE][+-]?\d++)?+/
WORD <- /(?>true|false|null)\b/
""",
    r"[ \t\r\n]*+",
)

C_SPACE = r"(?>\s++|//[^\n]*+|/\*(?>[^*]++|\*(?!/))*+\*/)*+"
JS_RESERVED = "if|else|for|while|do|return|function|class|const|let|var|new|typeof|void|delete|in|instanceof|try|catch|finally|throw|switch|case|default|break|continue|import|export|extends|null|true|false|this|super|with|debugger|enum"

_STRING = r'"(?>[^"\\\n]++|\\[^\n])*+"'
_WORD = rf"(?!(?>{JS_RESERVED}|async|await|yield)(?![\w$]))[a-zA-Z_$][\w$]*+(?! ?[=(.\[])"
_CALL = rf"(?!(?>{JS_RESERVED}|async|await|yield)(?![\w$]))[a-zA-Z_$][\w$]*+"
_JS_PLAIN = _plain(_WORD, _STRING, _CALL, r"[-+*%](?![-+*=])")
_JS_FAST = rf"(?>(?>(?>const [a-zA-Z_$][\w$]*+@ANNOTATED@ = |return |{_CALL} \+?= )?+{_JS_PLAIN};\s*+)++)"

_SCRIPT = r"""
File <- SHEBANG? (FAST / Stmt)* EOF
FAST <- /@FAST@/
NUMBERS <- /(?>\d++,\s*+)++/
SHEBANG <- /#![^\n]*/
EOF <- ~/\Z/
END <- /;|(?=\})|\Z|(?<=\n[^\S\n]*)/
ID <- /(?!(?:@RESERVED@)(?![\w$]))[\p{L}_$][\w$]*+/
NAME <- /#?[\p{L}_$][\w$]*+/
STRING <- /"(?>[^"\\\n]++|\\(?>\r\n|.))*+"|'(?>[^'\\\n]++|\\(?>\r\n|.))*+'/
TEMPLATE <- /`(?>[^`\\$]++|\\.|\$(?!\{))*+`/
OPENED <- /`(?>[^`\\$]++|\\.|\$(?!\{))*+\$\{/
BETWEEN <- /\}(?>[^`\\$]++|\\.|\$(?!\{))*+\$\{/
CLOSED <- /\}(?>[^`\\$]++|\\.|\$(?!\{))*+`/
Template <- TEMPLATE / OPENED Expr (BETWEEN Expr)* CLOSED
NUMBER <- /(?>0[xX][\da-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?>\d[\d_]*+(?>\.[\d_]*+)?+|\.\d[\d_]*+)(?>[eE][+-]?\d++)?+)n?+(?![\w$])/
REGEX <- /\/(?![*\/])(?>[^\/\\\[\n]++|\\[^\n]|\[(?>[^\]\\\n]++|\\[^\n])*+\])++\/[a-z]*+/
BINARY <- /(?>===?|!==?|>>>(?!=)|\*\*(?!=)|&&(?!=)|\|\|(?!=)|\?\?(?!=)|<<(?!=)|>>(?!=)|[<>]=?|[-+*\/%&|^](?!=)|(?>instanceof|in@AS@)(?![\w$]))/
ASSIGN <- /(?>=(?![=>])|(?>\*\*|<<|>>>?|&&|\|\||\?\?|[-+*\/%&|^])=)/
Stmt <- Block / ';' / Declared / 'with' '(' Expr ')' Stmt / If / For / While / Do / Try / Switch / Return / 'throw' Expr END / /(?>break|continue)(?![\w$])(?>[^\S\n]++(?!(?>@RESERVED@)(?![\w$]))[\p{L}_$][\w$]*+)?+/ END / Import / Export / 'debugger' END / @EXTRA@ Label / !ANONYMOUS Expr END
ANONYMOUS <- ~/(?>async\s++)?+(?>function|class)(?![\w$])/
Label <- ID /:(?!:)/ Stmt
Block <- '{' (FAST / Stmt)* '}'
Declared <- Var END / &NAMED Function / Class
NAMED <- ~/(?>async\s++)?+function\s*+\*?\s*+[\p{L}_$]/
Var <- 'const' Bound (',' Bound)* / /(?>await\s+)?using(?=[^\S\n]+(?!(?>in|of|instanceof)(?![\w$]))[\p{L}_$])/ Bound (',' Bound)* / /(?>let|var)(?![\w$])/ Binding (',' Binding)*
Bound <- Target @TYPE@ (/=(?![=>])/ Assign)@AMBIENT@
Binding <- Target @SURE@ @TYPE@ (/=(?![=>])/ Assign)?
Target <- ID / '{' (Field (',' Field)* ','?)? '}' / '[' (Slot? (',' Slot?)*)? ']'
Field <- '...' ID / PropName ':' Target (/=(?![=>])/ Assign)? / ID (/=(?![=>])/ Assign)?
Slot <- '...'? Target (/=(?![=>])/ Assign)?
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
For <- 'for' 'await'? '(' Loop ')' Stmt
Loop <- /(?>const|let|var)(?![\w$])/ Target @TYPE@ /(?>of|in)(?![\w$])/ Expr / Postfix /(?>of|in)(?![\w$])/ Expr / (/(?>const|let|var)(?![\w$])/ Binding (',' Binding)* / Expr)? ';' Expr? ';' Expr?
While <- 'while' '(' Expr ')' Stmt
Do <- 'do' Stmt 'while' '(' Expr ')' END
Try <- 'try' Block ('catch' ('(' Target @TYPE@ ')')? Block ('finally' Block)? / 'finally' Block)
Switch <- 'switch' '(' Expr ')' '{' (('case' Expr / 'default') ':' (!CASE Stmt)*)* '}'
CASE <- ~/(?>case|default)(?![\w$])/
Return <- 'return' (!RETURNEND Expr)? END
RETURNEND <- ~/[;}]/
Import <- 'import' !IMPORTCALL (@IMPORTED@ STRING / @IMPORTTYPE@ (Clause 'from' STRING)) Attributes? END
Attributes <- /(?>with|assert)(?=\s*\{)/ '{' (PropName ':' STRING (',' PropName ':' STRING)* ','?)? '}'
IMPORTCALL <- ~/[(.]/
Clause <- ID (',' Names)? / Names
Names <- '*' 'as' ID / '{' (Listed (',' Listed)* ','?)? '}'
Listed <- @LISTED@ (NAME / STRING) ('as' (NAME / STRING))?
Export <- @DECOR@ 'export' (@EXPORTED@'default' (Function / Class / Assign END) / @EXPORT@ Declared / Names ('from' STRING Attributes?)? END / '*' ('as' (NAME / STRING))? 'from' STRING Attributes? END)
Function <- 'async'? 'function' '*'? ID? @GENERIC@ Params @RETURNS@ @BODY@
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- @THIS@ @MODS@ '...'? Target @OPT@ @TYPE@ (/=(?![=>])/ Assign)?
Class <- @DECOR@ @ABSTRACT@ 'class' ID? @GENERIC@ ('extends' Postfix @TARGS@)? @IMPL@ '{' Member* '}'
Member <- ';' / @INDEXED@ @DECOR@ 'static' Block / @DECOR@ (MODIFIER @MODEND@)* (/(?>get|set)(?=\s+[\w$\[#"'])/ / '*')? (PropName / NAME) @OPT@ (@GENERIC@ Params @RETURNS@ @BODY@ / @TYPE@ (/=(?![=>])/ Assign)? END)
MODIFIER <- /(?>static|async@MODIFIERS@)(?=\s+[\w$\[#*"'{])/
PropName <- NAME / STRING / NUMBER / '[' Assign ']'
Expr <- Assign (',' Assign)*
Assign <- Arrow / Postfix ASSIGN Assign / Cond
Arrow <- 'async'? (ID &ARROW / @GENERIC@ Params @RETURNS@ &ARROW) ARROW (Block / Assign)
ARROW <- /=>/
Cond <- Binary (QUERY Assign ':' Assign / QUERY Cond ':' Assign)?
QUERY <- /\?(?![.?])/
Binary <- Unary (@CAST@ BINARY Unary)* @CAST1@
Unary <- @ANGLE@ /\+\+|--|[-+!~]/ Unary / /(?>typeof|void|delete|await|new(?!\s*+\.))(?![\w$])/ Unary / 'yield' '*'? Assign? / Postfix
Postfix <- Primary Suffix* /(?<!\n\s*)(?>\+\+|--)/?
Suffix <- '(' Args ')' / '[' Expr ']' / '?.' (NAME / '(' Args ')' / '[' Expr ']') / /\.(?!\.)/ NAME / Template @SUFFIX@
Args <- (Arg (',' Arg)* ','?)?
Arg <- '...'? Assign
Primary <- NUMBER / STRING / Template / REGEX / Function / Class / '[' Items ']' / '{' (Entry (',' Entry)* ','?)? '}' / '(' Expr ')' / CONSTANT / 'import' &IMPORTCALL / /new\s*+\.\s*+target(?![\w$])/ / /#[\p{L}_$][\w$]*+(?=\s+in(?![\w$]))/ / ID
CONSTANT <- /(?>this|super|null|true|false)(?![\w$])/
Items <- NUMBERS? ','* (Arg (','+ Arg)* ','*)?
Entry <- '...' Assign / (/(?>get|set|async)(?=\s+[\w$\[#"'*])/ / '*')* PropName (Params @RETURNS@ Block / ':' Assign) / ID (/=(?![=>])/ Assign)?
"""

_PLAIN = {"AS": "", "EXTRA": "", "TYPE": "", "IMPORTTYPE": "", "LISTED": "", "EXPORT": "", "GENERIC": "", "RETURNS": "", "BODY": "Block", "MODS": "", "SURE": "", "AMBIENT": "", "EXPORTED": "", "IMPORTED": "", "ANGLE": "", "INDEXED": "", "THIS": "", "OPT": "", "DECOR": "('@' Postfix)*", "ABSTRACT": "", "TARGS": "", "IMPL": "", "MODEND": "", "MODIFIERS": "", "CAST": "", "CAST1": "", "SUFFIX": ""}
_TYPED = {
    "AS": "", "EXTRA": "Typed /", "TYPE": "Ann?", "IMPORTTYPE": "/type(?=\\s+[\\w$*{])(?!\\s+from\\s+[\"'])/?", "LISTED": "/type(?=\\s+\\w)(?!\\s+as\\b)/?", "EXPORT": "Typed / /(?=[\\w@])/", "GENERIC": "Generic?", "RETURNS": "Ann?", "BODY": "(Block / END)", "SURE": "/!(?=\\s*:)/?", "AMBIENT": "?", "EXPORTED": "/=(?!=)/ Expr END / 'as' 'namespace' ID END / /type(?=\\s*[*{])/ (Names ('from' STRING Attributes?)? / '*' ('as' NAME)? 'from' STRING Attributes?) END / 'import' ID /=(?!=)/ Required END / ", "IMPORTED": "/type(?=\\s+\\w+\\s*=)/? ID /=(?!=)/ Required /", "ANGLE": "/<(?=[\\p{L}_$])/ Type '>' Unary /", "INDEXED": "MODIFIER* '[' ID ':' Type ']' Ann END /", "THIS": "/this(?![\\w$])/ Ann? /", "MODS": "('@' Postfix)* /(?>public|private|protected|readonly)(?=\\s+[\\w$])/*",
    "OPT": "/[?!](?=\\s*[:,)=;(\\n}])/?", "DECOR": "('@' Postfix)*", "ABSTRACT": "'abstract'?", "TARGS": "TypeArgs?", "IMPL": "('implements' Type (',' Type)*)?", "MODEND": "", "MODIFIERS": "|public|private|protected|readonly|abstract|declare|override|accessor", "CAST": "Cast*", "CAST1": "Cast*", "SUFFIX": "/ /!(?![=])/ / TypeArgs &CALL",
}
_TYPES = r"""
CALL <- ~/[(`]/
QUESTION <- ~/\?/
Cast <- /(?>as|satisfies)(?![\w$])/ ('const' / Type)
Required <- 'require' '(' STRING ')' / ID ('.' NAME)*
Ann <- ':' (/asserts(?=\s+[\w$])/ (ID / 'this') ('is' Type)? / Type)
Generic <- '<' TypeParam (',' TypeParam)* ','? '>'
TypeParam <- /(?>const|in|out)(?=\s+[\w$])/* ID ('extends' Type)? (/=(?!=)/ Type)?
TypeArgs <- '<' Type (',' Type)* '>'
Type <- FnType / Union ('extends' (FnType / Union) /\?/ Type ':' Type)?
Union <- /[|&](?![|&])/? TypeItem (/[|&](?![|&])/ TypeItem)*
FnType <- 'abstract'? 'new'? Generic? Params '=>' (/asserts(?=\s+[\w$])/ (ID / 'this') ('is' Type)? / Type)
TypeItem <- TypeUnit (/(?<!\n\s*)\[/ Type? ']')*
TypeUnit <- /import(?=\s*\()/ '(' Type (',' Type)? ')' ('.' NAME)* TypeArgs? / /infer(?=\s+\w)/ ID ('extends' Union !QUESTION)? / /(?>keyof|readonly|unique|typeof)(?=\s+[\w$({\["'])/ TypeUnit / STRING / TEMPLATE / OPENED Type (BETWEEN Type)* CLOSED / /-?/ NUMBER / '{' TypeMember* '}' / '[' (('...'? ID /\??:/)? '...'? Type /\?/? (',' ('...'? ID /\??:/)? '...'? Type /\?/?)* ','?)? ']' / '(' Type ')' / TYPENAME ('.' NAME)* TypeArgs? ('is' Type)?
TYPENAME <- /[\p{L}_$][\w$]*+/
TypeMember <- /[;,]/ / /(?>[-+]?readonly)(?=\s+[\w$\["'])/? /(?>get|set)(?=\s+[\w$\["'])/? ('[' ID ':' Type ']' / '[' ID 'in' Type ('as' Type)? ']' /[-+]?\??/ / PropName /\??/)? ('new'? Generic? Params Ann? / Ann)? /[;,]|(?=\})|(?<=\n[^\S\n]*)/
Typed <- 'interface' ID Generic? ('extends' Type (',' Type)*)? '{' TypeMember* '}' / 'type' ID Generic? '=' Type END / 'const'? 'enum' ID '{' (PropName ('=' Assign)? (',' PropName ('=' Assign)?)* ','?)? '}' / /(?>namespace|module)(?=\s+[\w$"'])/ (STRING / ID ('.' ID)*) Block / /global(?=\s*\{)/ Block / 'declare' (Typed / /(?>const|let|var)(?![\w$])/ Binding (',' Binding)* END / Function / Declared / 'global' Block / Stmt)
"""


def _script(fill: dict[str, str], more: str = "") -> Grammar:
    fast = _JS_FAST.replace("@ANNOTATED@", r"(?>: \w++)?+" if more else "").replace("/", r"\/")
    rules = _SCRIPT.replace("@RESERVED@", JS_RESERVED).replace("@FAST@", fast)
    for k, v in fill.items():
        rules = rules.replace(f"@{k}@", v)
    return Grammar(rules + more, C_SPACE)


JS = _script(_PLAIN)
TS = _script(_TYPED, _TYPES)

_JAVA_WORDS = "if|else|for|while|do|return|class|interface|enum|new|try|catch|finally|throw|switch|case|default|break|continue|this|super|instanceof|public|private|protected|static|final|int|long|double|float|boolean|char|byte|short|void|assert|synchronized|yield|var|record"
_JAVA_PLAIN = _plain(rf"(?!(?>{_JAVA_WORDS})(?![\w$]))[a-zA-Z_$][\w$]*+(?! ?[=(.\[<:])", _STRING, rf"(?!(?>{_JAVA_WORDS})(?![\w$]))[a-zA-Z_$][\w$]*+", r"[-+*%](?![-+*=])")
_JAVA_CALL = rf"(?!(?>{_JAVA_WORDS})(?![\w$]))[a-zA-Z_$][\w$]*+\((?>{_JAVA_PLAIN}(?>, ?{_JAVA_PLAIN})*+)?+\)"
_JAVA_FAST = rf"(?>(?>var [a-zA-Z_$][\w$]*+ = {_JAVA_PLAIN}|return {_JAVA_PLAIN}|(?!(?>{_JAVA_WORDS})(?![\w$]))[a-zA-Z_$][\w$]*+ \+?= {_JAVA_PLAIN}|{_JAVA_CALL});\s*+)++".replace("/", r"\/")

JAVA = Grammar(
    r"""
File <- Annotation* ('package' Qualified ';')? Import* (Annotation* 'open'? 'module' Qualified '{' Directive* '}' / Type*) EOF
Directive <- /(?>requires|exports|opens|uses|provides)(?=\s)/ /(?>static|transitive)(?=\s)/* Qualified (/(?>to|with)(?=\s)/ Qualified (',' Qualified)*)? ';'
EOF <- ~/\Z/
Import <- 'import' 'static'? Qualified ('.' '*')? ';'
Qualified <- ID ('.' ID)*
ID <- /(?!(?:if|else|for|while|do|return|class|interface|enum|new|try|catch|finally|throw|throws|switch|case|default|break|continue|import|package|extends|implements|null|true|false|this|super|instanceof|public|private|protected|static|final|abstract|void|int|long|double|float|boolean|char|byte|short|synchronized|assert|native|volatile|transient)(?![\w$]))[\p{L}_$][\w$]*+/
PRIMITIVE <- /(?>int|long|double|float|boolean|char|byte|short)(?![\w$])/
STRING <- /\"\"\"(?>[^"\\]++|\\.|"(?!""))*+\"\"\"|"(?>[^"\\\n]++|\\[^\n])*+"/
CHAR <- /'(?>[^'\\\n]|\\[^\n][0-9a-fA-F]*+)'/
NUMBER <- /(?>0[xX][\da-fA-F_]++|0[bB][01_]++|(?>\d[\d_]*+(?>\.[\d_]*+)?+|\.\d[\d_]*+)(?>[eE][+-]?\d++)?+)[lLfFdD]?+(?![\w$])/
Annotation <- '@' !ATTYPE Qualified ('(' ((ID '=' Element (',' ID '=' Element)*) / Element)? ')')?
ATTYPE <- ~/interface/
Element <- Annotation / '{' (Element (',' Element)* ','?)? '}' / Cond
MODIFIER <- /(?>public|private|protected|static|final|abstract|native|synchronized|transient|volatile|strictfp|default(?!\s*[:\-])|sealed(?=\s)|non-sealed)(?![\w$])/
Type <- ';' / (Annotation / MODIFIER)* TypeBody
TypeBody <- 'class' ID Generic? ('extends' Ref)? ('implements' Refs)? ('permits' Refs)? Body / /@?interface(?![\w$])/ ID Generic? ('extends' Refs)? ('permits' Refs)? Body / 'enum' ID ('implements' Refs)? '{' (Constant (',' Constant)*)? ','? (';' Member*)? '}' / 'record' ID Generic? '(' Params ')' ('implements' Refs)? Body
Constant <- Annotation* ID ('(' Args ')')? Body?
Refs <- Ref (',' Ref)*
Generic <- '<' Annotation* ID ('extends' Ref ('&' Ref)*)? (',' ID ('extends' Ref ('&' Ref)*)?)* '>'
Ref <- (PRIMITIVE / Annotation* ID TypeArgs? ('.' ID TypeArgs?)*) ('[' ']')*
TypeArgs <- '<' (TypeArg (',' TypeArg)*)? '>'
TypeArg <- '?' (/(?>extends|super)(?![\w$])/ Ref)? / Ref
Body <- '{' Member* '}'
Member <- ';' / 'static'? Block / (Annotation / MODIFIER)* (TypeBody / Generic? (('void' / Ref) ID '(' Params ')' ('[' ']')* Throws? (Block / ('default' Element)? ';') / ID '(' Params ')' Throws? Block / ID Block / Ref Vars ';'))
Throws <- 'throws' Refs
Params <- (Param (',' Param)*)?
Param <- (Annotation / 'final')* Ref '...'? (ID / 'this') ('[' ']')*
Vars <- Var (',' Var)*
Var <- ID ('[' ']')* (/=(?!=)/ Init)?
Init <- '{' NUMBERS? (Init (',' Init)* ','?)? '}' / Expr
Block <- '{' (FAST / Stmt)* '}'
FAST <- /@FAST@/
NUMBERS <- /(?>\d++,\s*+)++/
Stmt <- Block / ';' / If / 'for' '(' ForHead ')' Stmt / 'while' '(' Expr ')' Stmt / 'do' Stmt 'while' '(' Expr ')' ';' / Try / Switch / 'return' Expr? ';' / 'throw' Expr ';' / /(?>break|continue)(?![\w$])/ ID? ';' / 'synchronized' '(' Expr ')' Block / 'assert' Expr (':' Expr)? ';' / 'yield' !YIELDNOT Expr ';' / LocalType / Local ';' / Call ';' / ID /:(?!:)/ Stmt
YIELDNOT <- ~/[=.(\[+-]/
If <- 'if' '(' Expr ')' Stmt ('else' Stmt)?
LocalType <- (Annotation / /(?>final|abstract|static)(?![\w$])/)* TypeBody
Local <- (Annotation / 'final')* Ref &NEXTID Vars
NEXTID <- ~/[\p{L}_$]/
ForHead <- (Annotation / 'final')* Ref ID ':' Expr / (Local / Call (',' Call)*)? ';' Expr? ';' (Call (',' Call)*)?
Try <- 'try' ('(' Resource (';' Resource)* ';'? ')' Block Catch* ('finally' Block)? / Block (Catch+ ('finally' Block)? / 'finally' Block))
Resource <- Local / Postfix
Catch <- 'catch' '(' (Annotation / 'final')* Ref ('|' Ref)* ID ')' Block
Switch <- 'switch' '(' Expr ')' '{' Case* '}'
Case <- ('case' CaseItem (',' CaseItem)* ('when' Expr)? / 'default') ('->' (Block / 'throw' Expr ';' / Expr ';') / ':' (!CASE Stmt)*)
CASE <- ~/(?>case|default)(?![\w$])/
CaseItem <- Local / 'default' / Cond
Call <- /\+\+|--/ Unary / Postfix (ASSIGN Expr)?
ASSIGN <- /(?>=(?!=)|(?>>>>?|<<|[-+*\/%&|^])=)/
Expr <- Lambda / Postfix ASSIGN Expr / Cond
Lambda <- &LAMBDA (ID / '(' (ID (',' ID)* / Params)? ')') '->' (Block / Expr)
LAMBDA <- ~/(?>[\p{L}_$][\w$]*+|\([^()]*+\))\s*+->/
Cond <- Binary ('?' (Lambda / Cond) ':' (Lambda / Cond))?
Binary <- Unary (BINARY Unary / 'instanceof' 'final'? Ref ID?)*
BINARY <- /(?>==|!=|>>>?(?!=)|<<(?!=)|[<>]=?|&&|\|\||[-+*\/%&|^](?!=))/
Unary <- /\+\+|--|[-+!~](?!=)/ Unary / Cast / Postfix
Cast <- '(' PRIMITIVE ('[' ']')* ')' Unary / '(' Ref ('&' Ref)* ')' &CASTED (Lambda / Unary)
CASTED <- ~/[\p{L}_$"'\d(!~]/
Postfix <- Primary Suffix* /\+\+|--/?
Suffix <- '.' ('new' Creator / TypeArgs? (ID / 'this' / 'super' / 'class')) / '(' Args ')' / ('[' ']')+ ('.' 'class' / '::' 'new') / '[' Expr ']' / '::' (ID / 'new')
Args <- (Expr (',' Expr)*)?
Primary <- NUMBER / STRING / CHAR / /(?>true|false|null|this|super)(?![\w$])/ / 'switch' &PAREN Switch1 / '(' Expr ')' / 'new' Creator / (PRIMITIVE / 'void') ('[' ']')* ('.' 'class' / '::' 'new') / ID (('[' ']')+ ('.' 'class' / '::' 'new') / TypeArgs '::' (ID / 'new'))?
PAREN <- ~/\(/
Switch1 <- '(' Expr ')' '{' Case* '}'
Creator <- (PRIMITIVE / ID TypeArgs? ('.' ID TypeArgs?)*) (('[' ']')+ Init / ('[' Expr ']')+ ('[' ']')* / '(' Args ')' Body?)
""".replace("@FAST@", _JAVA_FAST),
    C_SPACE,
)

_GO_WORDS = "break|case|chan|const|continue|default|defer|else|fallthrough|for|func|go|goto|if|import|interface|map|package|range|return|select|struct|switch|type|var"
_GO_PLAIN = _plain(rf"(?!(?>{_GO_WORDS})\b)[a-zA-Z_]\w*+(?! ?[=(.\[{{:])", _STRING, rf"(?!(?>{_GO_WORDS})\b)[a-zA-Z_]\w*+", r"[-+*%](?![-+*=])")
_GO_CALL = rf"(?!(?>{_GO_WORDS})\b)[a-zA-Z_]\w*+\((?>{_GO_PLAIN}(?>, ?{_GO_PLAIN})*+)?+\)"
_GO_FAST = rf"(?>(?>(?!(?>{_GO_WORDS})\b)[a-zA-Z_]\w*+ (?>:=|\+?=) {_GO_PLAIN}|return {_GO_PLAIN}|{_GO_CALL})[^\S\n]*+\n\s*+)++".replace("/", r"\/")

GO = Grammar(
    r"""
File <- NL* 'package' ID SEMI (Import SEMI)* (Top SEMI)* EOF
EOF <- ~/\Z/
NL <- /[;\n]/
SEMI <- /(?>[;\n]\s*+)++|(?=[})])|\Z/
ID <- /(?!(?>break|case|chan|const|continue|default|defer|else|fallthrough|for|func|go|goto|if|import|interface|map|package|range|return|select|struct|switch|type|var)\b)[\p{L}_]\w*+/
STRING <- /"(?>[^"\\\n]++|\\[^\n])*+"|`[^`]*+`/
RUNE <- /'(?>[^'\\\n]|\\[^'\n]++|\\')'/
NUMBER <- /(?>0[xX][\da-fA-F_]++|0[bB][01_]++|0[oO][0-7_]++|(?>\d[\d_]*+(?>\.[\d_]*+)?+|\.\d[\d_]*+)(?>[eE][+-]?\d++)?+)i?+(?!\w)/
Import <- 'import' (Spec / '(' NL* (Spec SEMI NL*)* ')')
Spec <- ('.' / ID)? STRING
Top <- Func / Decl
Decl <- 'const' Group1 / 'var' Group2 / 'type' Group3
Group1 <- '(' NL* (ConstSpec SEMI NL*)* ')' / ConstSpec
Group2 <- '(' NL* (VarSpec SEMI NL*)* ')' / VarSpec
Group3 <- '(' NL* (TypeSpec SEMI NL*)* ')' / TypeSpec
ConstSpec <- Ids (Type? '=' Exprs)?
VarSpec <- Ids ('=' Exprs / Type ('=' Exprs)?)
TypeSpec <- ID TypeParams? '='? Type
TypeParams <- '[' ID (',' ID)* Constraint (',' ID (',' ID)* Constraint)* ','? ']'
Constraint <- '~'? Type ('|' '~'? Type)*
Ids <- ID (',' ID)*
Func <- 'func' Params? ID TypeParams? Signature Block?
Signature <- Params (Params / Type)?
Params <- '(' (Param (',' Param)* ','?)? ')'
Param <- ID '...'? Type / '...'? Type
Type <- ID ('.' ID)? (~/(?=\[)/ '[' Type (',' Type)* ']')? / '*' Type / '[' (']' / '...' ']' / Expr ']') Type / 'map' '[' Type ']' Type / 'func' Signature / 'struct' Struct / 'interface' Interface / '<-'? 'chan' '<-'? Type / '(' Type ')'
Struct <- '{' NL* ((Ids Type / '*'? ID ('.' ID)?) STRING? SEMI NL*)* '}'
Interface <- '{' NL* ((ID Signature / Constraint) SEMI NL*)* '}'
Block <- '{' NL* Stmts '}'
Stmts <- (FAST / Stmt SEMI NL*)*
FAST <- ~/@FAST@/
Stmt <- Decl / 'return' Exprs? / If / For / Switch / Select / Block / /(?>break|continue|goto)\b/ ID? / 'fallthrough' / /(?>go|defer)\b/ Expr / !CASE ID ':' !DEFINE NL* Stmt? / Simple
DEFINE <- ~/=/
CASE <- ~/(?>case|default)\b/
Simple <- Exprs (ASSIGN Exprs / /\+\+|--/ / '<-' Expr)?
ASSIGN <- /(?>:=|=(?!=)|(?><<|>>|&\^|[-+*\/%&|^])=)/
If <- 'if' Head Block ('else' (If / Block))?
Head <- (PSimple? ';')? PSimple
PSimple <- PExprs (ASSIGN PExprs / /\+\+|--/ / '<-' PExpr)?
For <- 'for' (Range / PSimple? ';' PExpr? ';' PSimple? / PExpr)? Block
Range <- (PExprs /:=|=(?!=)/)? 'range' PExpr
Switch <- 'switch' ((PSimple? ';')? (ID ':=')? PSimple? ) '{' NL* (('case' (Exprs / Type (',' Type)*) / 'default') ':' NL* (!CASE Stmt SEMI NL*)*)* '}'
Select <- 'select' '{' NL* (('case' Simple / 'default') ':' NL* (!CASE Stmt SEMI NL*)*)* '}'
Exprs <- Expr (',' Expr)*
PExprs <- PExpr (',' PExpr)*
Expr <- Unary (BINARY Unary)*
PExpr <- PUnary (BINARY PUnary)*
BINARY <- /(?>==|!=|<=|>=|&&|\|\||<<(?!=)|>>(?!=)|&\^(?!=)|<(?!-)|>|[-+*\/%&|^](?!=))/
Unary <- /<-|[-+!^*&](?!=)/ Unary / Primary Suffix*
PUnary <- /<-|[-+!^*&](?!=)/ PUnary / PPrimary Suffix*
Suffix <- '.' (ID / '(' (Type / 'type') ')') / '(' (Arg (',' Arg)* ','?)? ')' / '[' (Expr? ':' Expr? (':' Expr)? / Expr (',' Type)* / Type (',' Type)*) ']'
Arg <- Type1 / Expr '...'?
Type1 <- &TYPESTART Type !AFTERTYPE
TYPESTART <- ~/\[\]|map\b|chan\b|struct\b|interface\b|\*/
AFTERTYPE <- ~/[({.]/
Primary <- NUMBER / STRING / RUNE / Lambda / Composite / Conversion / '(' (Expr / Type) ')' / ID
PPrimary <- NUMBER / STRING / RUNE / Lambda / Composite1 / Conversion / '(' (Expr / Type) ')' / ID
Lambda <- 'func' Signature Block
Conversion <- &CONVERTED Type &PAREN
CONVERTED <- ~/\[|map\b|chan\b|interface\b|func\b/
PAREN <- ~/\(/
Composite <- (&CONVERTED Type / 'struct' Struct / ID ('.' ID)? (~/(?=\[[\w*\]])/ '[' Type (',' Type)* ']')?) Literal
Composite1 <- (&CONVERTED Type / 'struct' Struct) Literal
Literal <- '{' NL* NUMBERS? (Element (',' NL* Element)* (',' NL*)?)? '}'
NUMBERS <- /(?>\d++,\s*+)++(?=\d)/
Element <- (Literal / Expr) (':' (Literal / Expr))?
""".replace("@FAST@", _GO_FAST),
    r"(?>\s++|//[^\n]*+|/\*(?>[^*]++|\*(?!/))*+\*/)*+",
    r"(?>[^\S\n]++|//[^\n]*+|/\*(?>[^*\n]++|\*(?!/))*+\*/)*+",
    r"[)\]}]|return|fallthrough|\x00(?!\(\?>(?:==|<<|:=)|<-|:=|\[;).*(?:p\{L\}|\[\^\"|\[\^'|\\d\[|\\\+\\\+|break).*",
)


CARRIAGE = regex.compile(r"\r\n")
_GO_PIECE = regex.compile(r"/\*(?>[^*]++|\*(?!/))*+\*/|\"(?>[^\"\\\n]++|\\[^\n])*+\"|`[^`]*+`|'(?>[^'\\\n]|\\[^'\n]++|\\')'|//[^\n]*+")


def _go_text(text: Moved) -> Moved:
    # a comment over several lines stands for a line end, as the language has it
    return text.sub(CARRIAGE, lambda m: "\n").sub(_GO_PIECE, lambda m: ("\n" if "\n" in m[0] else " ") if m[0].startswith("/*") else "" if m[0].startswith("//") else m[0])


GO.prepare = _go_text

RUBY_KEYWORDS = "if|unless|while|until|for|do|end|def|class|module|begin|rescue|ensure|else|elsif|case|when|in|then|return|and|or|not|nil|true|false|self|yield|super|break|next|redo|retry|alias|undef|defined\\?"
_RUBY_WORDS = "if|unless|while|until|for|do|end|def|class|module|begin|rescue|ensure|else|elsif|case|when|in|then|return|and|or|not|nil|true|false|self|yield|super|break|next|redo|retry|alias|undef"
_RUBY_STRING = r'"(?>[^"\\\n#]++|\\[^\n]|#(?!\{))*+"'
_RUBY_PLAIN = _plain(rf"(?!(?>{_RUBY_WORDS})(?![\w?!]))[a-zA-Z_]\w*+(?! ?[=(.\[{{?!:])", _RUBY_STRING, rf"(?!(?>{_RUBY_WORDS})(?![\w?!]))[a-z_]\w*+", r"[-+*](?![-+*=])")
_RUBY_FAST = rf"(?>(?>(?!(?>{_RUBY_WORDS})(?![\w?!]))[a-zA-Z_]\w*+ \+?= {_RUBY_PLAIN}|return {_RUBY_PLAIN}|{_RUBY_PLAIN})[^\S\n]*+\n(?>\s++|#[^\n]*+)*+(?!\.(?!\.)|&\.))++".replace("/", r"\/")
RUBY = Grammar(
    r"""
File <- Stmts EOF
FAST <- ~/@FAST@/
NUMBERS <- /(?>\d++,\s*+)++(?=\d)/
EOF <- ~/\Z/
NL <- /[;\n]/
SEP <- /(?>[;\n](?>\s++|#[^\n]*+)*+)++/
Stmts <- SEP? (FAST / Stmt (SEP / &CLOSE / EOF))*
CLOSE <- ~/(?>end|else|elsif|when|in|rescue|ensure|then)(?![\w?!:])|[})]/
Stmt <- Base Modifier*
Modifier <- /(?>if|unless|while|until|rescue)(?!\w)/ Full
Base <- Def / Class / Module / 'alias' WORD WORD / 'undef' WORD / /(?>BEGIN|END)(?=\s*\{)/ '{' Stmts '}' / Full
WORD <- /:?[\p{L}_]\w*+[?!=]?/
Def <- /(?>private|public|protected|module_function|private_class_method)(?=\s+def\b)/? 'def' DefName (/\(/ SEP? Params SEP? ')' / &PARAMSTART Params)? (/=(?![=~])/ Stmt / Body 'end')
PARAMSTART <- ~/[\p{L}_*&]/
DefName <- /(?>(?>self|[A-Z]\w*+|[a-z_]\w*+)\.)?(?>[\p{L}_]\w*+(?>[?!]|=(?=\s*\())?+|\[\]=?|[-+!~]@?|\*\*?|[\/%&|^]|<=>|<<|>>|<=?|>=?|===?|=~|!=)/
Params <- (Param (',' SEP? Param)*)?
Param <- /\*\*?|&|\.\.\./ ID? / ID (/:(?!:)/ (Ternary)? / /=(?![=~>])/ Ternary)? / '(' Params ','? ')'
ID <- /(?!(?>@KW@)(?![\w?!:]))[a-z_\p{Ll}]\w*+/
Class <- 'class' ('<<' Full / CONST ('<' Full)?) Body 'end'
Module <- 'module' CONST Body 'end'
CONST <- /(?>::)?[A-Z]\w*+(?>::[A-Z]\w*+)*+/
Body <- Stmts Rescue* ('else' Stmts)? ('ensure' Stmts)?
Rescue <- 'rescue' (('*'? Ternary (',' SEP? '*'? Ternary)*)? ('=>' Lhs)?)? /then(?!\w)/? Stmts
Lhs <- Postfix
Full <- Not (/(?>and|or)(?!\w)/ SEP? Not)*
Not <- 'not' Not / Jump / Multi / Expr
Jump <- /(?>return|break|next)(?![\w?!])/ (&ARGSTART Args)?
ARGSTART <- ~/(?!(?>if|unless|while|until|rescue|and|or|end|then|do)(?![\w?!:]))[^\s;})\]]/
Multi <- Target ((',' Target)+ ','? / ',')? &EQUAL /=(?![=~>])/ SEP? Args
EQUAL <- ~/=(?![=~>])/
Target <- '(' Target (',' Target)* ','? ')' / '*' Postfix? / Postfix
Expr <- Assign
Assign <- Ternary (ASSIGN SEP? (Jump / /\*(?=[\w@$(\[])/ Ternary (',' SEP? Splat)* / Assign (',' SEP? Splat)*) (/rescue(?!\w)/ Assign)?)?
ASSIGN <- /(?>=(?![=~>])|(?>\*\*|<<|>>|&&|\|\||[-+*\/%&|^])=)/
Ternary <- Range (/\?(?=\s)|(?<=[\])])\?/ SEP? Ternary SEP? /:(?!:)/ SEP? Ternary)?
Range <- /\.\.\.?/ Binary / Binary (/\.\.\.?/ Binary?)?
Binary <- Unary (BINARY SEP? Unary)*
BINARY <- /(?><=>|===?|=~|!=|!~|\*\*(?!=)|&&(?!=)|\|\|(?!=)|<<(?![=~A-Z"'-])|<<(?=\s)|>>(?!=)|[<>]=?|[-+*\/%&|^](?!=))/
Unary <- /!(?![=~])|[-+~](?=[\w@$(\[:"'])|&(?=[:\w])/ Unary / 'defined?' Unary / Postfix
Postfix <- Primary Suffix*
Suffix <- /(?>\s*\n\s*(?>#[^\n]*\n\s*)*)?(?>&\.|\.(?!\.))(?>\s*\n\s*(?>#[^\n]*\n\s*)*)?/ (METHOD / '(') Call? / /(?<=[^\s])::/ (CONSTNAME / METHOD) Call? / /(?<![\s,])\[/ SEP? ArgList? SEP? ']' / ParenArgs Blocked? / Blocked
CONSTNAME <- /[A-Z]\w*+/
METHOD <- /[\p{L}_]\w*+[?!]?(?!=(?![=~>]))|[\p{L}_]\w*+|[-+*\/%<>=!~^&|\[\]]+(?=[\s(])/
Call <- ParenArgs Blocked? / &SPACEARG Args Blocked?
ParenArgs <- /(?<=[\w?!])\(/ SEP? ArgList? SEP? ')'
SPACEARG <- ~/(?<=[\w?!][ \t]+)(?!(?>if|unless|while|until|rescue|and|or|end|then|do|in)(?![\w?!:]))(?>[\p{L}_@$"'\d:(]|\[(?!\s)|\/(?![\s=])|->|[-*&!](?=[\w@$:"'(\[])|::[A-Z]|<<[~-]?["'A-Z]|%[wiqQ]?[\[({<|])/
Blocked <- /do(?!\w)/ BlockParams? Body 'end' / '{' BlockParams? Stmts '}'
BlockParams <- '|' (Params ','? (';' ID (',' ID)*)?)? '|'
Args <- Arg (',' SEP? Arg)*
ArgList <- Arg (SEP? ',' SEP? Arg)* (SEP? ',')?
Arg <- /\*\*?|&/ Ternary? / LABEL SEP? (Jump / NoComma)? / NoComma (/=>/ SEP? NoComma)?
Splat <- /\*\*?|&/ Ternary? / NoComma
NoComma <- 'not' NoComma / Ternary (ASSIGN SEP? NoComma)?
LABEL <- /(?>[\p{L}_]\w*+[?!]?|"(?>[^"\\]++|\\.)*+"|'(?>[^'\\]++|\\.)*+'):(?!:)/
Primary <- If / Unless / While / For / Case / Begin / Lambda / Def / Class / NUMBER / Strings / SYMBOL / HEREDOC / PERCENT / REGEX / '[' SEP? NUMBERS? ArgList? SEP? ']' / '{' SEP? (Pair (SEP? ',' SEP? Pair)* (SEP? ',')?)? SEP? '}' / '(' Stmts ')' / KEYWORDVALUE Call? / VARIABLE / CONSTANT Call? / ID1 Call?
ID1 <- /(?!(?>@KW@)(?![\w?!:]))[a-z_\p{Ll}]\w*+[?!]?(?!=(?![=~>]))|(?!(?>@KW@)(?![\w?!:]))[a-z_\p{Ll}]\w*+/
CONSTANT <- /(?>::)?[A-Z]\w*+/
KEYWORDVALUE <- /(?>nil|true|false|self|__FILE__|__dir__|__method__|__LINE__|yield|super|redo|retry)(?![\w?!])/
VARIABLE <- /@@?[\p{L}_]\w*+|\$(?>[\p{L}_]\w*+|\d+|[!@&~?:;,.<>0-9*$"'\/\\])/
Strings <- (STRING / Filled)+
STRING <- /"(?>[^"\\#]++|\\.|#(?!\{))*+"|'(?>[^'\\]++|\\.)*+'|`(?>[^`\\]++|\\.)*+`|\?[\p{L}_](?!\w)/
Filled <- OPENED Stmts (BETWEEN Stmts)* CLOSED
OPENED <- /"(?>[^"\\#]++|\\.|#(?!\{))*+#\{/
BETWEEN <- /\}(?>[^"\\#]++|\\.|#(?!\{))*+#\{/
CLOSED <- /\}(?>[^"\\#]++|\\.|#(?!\{))*+"/
SYMBOL <- /:(?>(?>@@?|\$)[\p{L}_]\w*+|"(?>[^"\\]++|\\.)*+"|'(?>[^'\\]++|\\.)*+'|[\p{L}_]\w*+[?!=]?(?!=>)|[\p{L}_]\w*+|\[\]=?|[-+*\/<>=!~%&|^]+)/
HEREDOC <- /<<[~-]?(?>"\w+"|'\w+'|[A-Z_]\w*+)/
PERCENT <- /%[wWiIqQrsx]?(?>\[(?>[^\[\]\\]++|\\.|\[[^\]]*\])*+\]|\((?>[^()\\]++|\\.|\([^)]*\))*+\)|\{(?>[^{}\\]++|\\.|\{[^}]*\})*+\}|<[^>]*+>|\|[^|]*+\||![^!]*+!|(?<=%[a-zA-Z])\/(?>[^\/\\]++|\\.)*+\/)[a-z]*+/
REGEX <- /\/(?>[^\/\\\[]++|\\.|\[(?>[^\]\\\n]++|\\.)*+\]|\[)*+\/[a-z]*+/
NUMBER <- /(?>0[xX][\da-fA-F_]++|0[bB][01_]++|\d[\d_]*+(?>\.\d[\d_]*+)?+(?>[eE][+-]?\d++)?+)[ri]?+(?!\w)/
Pair <- /\*\*/ Ternary / LABEL SEP? NoComma? / NoComma /=>/ SEP? NoComma
If <- 'if' Full Then Stmts ('elsif' Full Then Stmts)* ('else' Stmts)? 'end'
Unless <- 'unless' Full Then Stmts ('else' Stmts)? 'end'
Then <- SEP? 'then' / SEP
While <- /(?>while|until)(?!\w)/ Full (/do(?!\w)/ / SEP) Stmts 'end'
For <- 'for' Lhs (',' Lhs)* 'in' Full (/do(?!\w)/ / SEP) Stmts 'end'
Case <- 'case' Full? SEP (/(?>when|in)(?!\w)/ Args Modifier? Then Stmts)+ ('else' Stmts)? 'end'
Begin <- 'begin' Body 'end'
Lambda <- '->' ('(' Params ')' / Params)? ('{' Stmts '}' / /do(?!\w)/ Body 'end')
""".replace("@KW@", RUBY_KEYWORDS).replace("@FAST@", _RUBY_FAST),
    r"(?>[^\S\n]++|#[^\n]*+|\\\n)*+",
)


BLOCK_COMMENT = regex.compile(r"^=begin\b.*?(?:^=end\b[^\n]*\n?|\Z)|^__END__[ \t]*$.*", regex.S | regex.M)
QUOTED = regex.compile(r"(?<!<<)(?<!<<[~-])(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*')")
HERE = regex.compile(r"<<([~-]?)(?:([\"'`])([^\"'`\n]+)\2|([\p{L}_]\w*))")


def _here(line: str) -> list[tuple[str, str]]:
    """(indent sign, end word) of the here-documents that a line opens."""
    bare = regex.sub(r"#(?!\{).*", "", QUOTED.sub('""', line))
    return [(m[1], m[3] or m[4]) for m in HERE.finditer(bare) if m[1] or m[3] or m[4][0].isupper() and not regex.search(r"(?:class|[\w)\]]) ?$", bare[: m.start()])]


def _ruby_text(text: Moved) -> Moved:
    """Without block comments, text after __END__ and bodies of here-documents."""
    text = text.sub(CARRIAGE, lambda m: "\n")
    if "<<" not in text.text:
        return text.sub(BLOCK_COMMENT, lambda m: "")

    def pieces() -> Iterator[tuple[str, int]]:
        # block comments are looked for outside here-documents alone
        at, waiting, whole, inside = 0, [], text.text, False
        for line in whole.split("\n"):
            start, at = at, at + len(line) + 1
            if waiting:
                if line.strip() == waiting[0][1] and (waiting[0][0] or line == waiting[0][1]):
                    waiting.pop(0)
                continue
            if inside:
                inside = not regex.match(r"=end\b", line)
                continue
            if regex.match(r"=begin\b", line):
                inside = True
                continue
            if regex.fullmatch(r"__END__[ \t]*", line):
                return
            yield (line + "\n" if at <= len(whole) else line), start
            if "<<" in line and not line.startswith("<<<<"):
                waiting = _here(line)
        if waiting:
            yield "(", len(whole)  # an open here-document can't be accepted

    return text.pieces(pieces())


RUBY.prepare = _ruby_text

PY_KEYWORDS = "False|None|True|and|as|assert|async|await|break|class|continue|def|del|elif|else|except|finally|for|from|global|if|import|in|is|lambda|nonlocal|not|or|pass|raise|return|try|while|with|yield"
_PY_PLAIN = _plain(rf"(?!(?>{PY_KEYWORDS})(?!\w))[a-zA-Z_]\w*+(?! ?[=(.\[\"':])", r'"(?>[^"\\\n]++|\\[^\n])*+"', rf"(?!(?>{PY_KEYWORDS})(?!\w))[a-zA-Z_]\w*+", r"[-+*%](?![-+*=])")
_PY_FAST = rf"(?>(?>(?!(?>{PY_KEYWORDS})(?!\w))[a-zA-Z_]\w*+ \+?= {_PY_PLAIN}|return {_PY_PLAIN}|{_PY_PLAIN})[ \t]*+\n)++".replace("/", r"\/")
#: The quote of each kind of formatted string and what else its text may hold.
_FORMATTED = {"A": ('"""', '"(?!"")'), "B": ("'''", "'(?!'')"), "C": ('"(?!"")', ""), "D": ("'(?!'')", "")}


def _formatted(kind: str, opened: str, more: str) -> str:
    """The rules of a kind of formatted string: text, and fields with an expression, a conversion and a nested format."""
    close = opened.split("(")[0]
    but, also = close[0] + ("" if more else r"\n"), f"|{more}" if more else ""
    return rf"""
OPEN{kind} <- ~/(?>[fFtT][rR]?+|[rR][fFtT]){opened}/
TEXT{kind} <- ~/(?>[^{but}\\{{}}]++|\\N\{{[A-Z][^{{}}\n]*+\}}|\\[^{{}}]|\\(?=[{{}}])|\{{\{{|\}}\}}{also})++/
CLOSE{kind} <- /{close}/
SPEC{kind} <- ~/(?>[^{but}{{}}]++{also})++/
Field{kind} <- '{{' (Yield / Star) /=(?!=)/? /![rsa](?=[ ]*[:}}])/? (~/:/ (SPEC{kind} / Field{kind})*)? ~/\}}/"""


PYTHON = Grammar(
    r"""
File <- (FAST / Stmt)* EOF
FAST <- ~/@FAST@/
NUMBERS <- /(?>[1-9]\d*+,\s*+)++(?=\d)/
EOF <- ~/\Z/
NEWLINE <- /\n/
INDENT <- /\x01/
DEDENT <- /\x02/
ID <- /(?!(?>@KW@)(?!\w))[\p{L}_]\w*+/
Stmt <- Compound / Simple
Block <- NEWLINE INDENT (FAST / Stmt)+ DEDENT / Simple
Simple <- Small (';' Small)* ';'? NEWLINE
Small <- /(?>pass|break|continue)(?!\w)/ / 'return' Star? / 'raise' (Test ('from' Test)?)? / 'import' Dotted ('as' ID)? (',' Dotted ('as' ID)?)* / From / /(?>global|nonlocal)(?!\w)/ ID (',' ID)* / 'del' Targets / 'assert' Test (',' Test)? / 'type' ID TypeParams? /=(?!=)/ Test / Yield / Assignment
Dotted <- ID ('.' ID)*
From <- 'from' (/\.+/ Dotted? / Dotted) 'import' ('*' / '(' Names ','? ')' / Names)
Names <- ID ('as' ID)? (',' ID ('as' ID)?)*
Assignment <- (Targets /=(?!=)/)+ Right / (Single / '(' Single ')') ':' Test (/=(?!=)/ Right)? / (Single / '(' Single ')') AUGMENT Right / Star
Single <- Atom (Suffix &MORE)* ('.' ID / '[' Subscript (',' Subscript)* ','? ']') / ID
MORE <- ~/[.(\[]/
AUGMENT <- /(?>\*\*|\/\/|<<|>>|[-+*\/%&|^@])=/
Right <- Yield / Star
Yield <- 'yield' ('from' Test / Star)?
Compound <- If / For / While / Def / Class / Try / With / Match / '@' Named NEWLINE Decorated / 'async' (For / Def / With)
Decorated <- '@' Named NEWLINE Decorated / 'async'? Def / Class
If <- 'if' Named ':' Block ('elif' Named ':' Block)* ('else' ':' Block)?
For <- 'for' Targets 'in' Star ':' Block ('else' ':' Block)?
While <- 'while' Named ':' Block ('else' ':' Block)?
Def <- 'def' ID TypeParams? '(' Params ')' ('->' Test)? ':' Block
Class <- 'class' ID TypeParams? ('(' Args ')')? ':' Block
TypeParams <- '[' /\*\*?/? ID (':' Test)? (',' /\*\*?/? ID (':' Test)?)* ','? ']'
Try <- 'try' ':' Block (Except+ ('else' ':' Block)? ('finally' ':' Block)? / 'finally' ':' Block)
Except <- 'except' '*'? (Test (',' Test)* ('as' ID)?)? ':' Block
With <- 'with' ('(' Item (',' Item)* ','? ')' ':' / Item (',' Item)* ':') Block
Item <- Test ('as' Target)?
Match <- /match(?!\w)(?=[^=\n]*:)/ Star ':' NEWLINE INDENT ('case' Pattern ('if' Named)? ':' Block)+ DEDENT
Pattern <- OrPattern ('as' ID)? (',' (OrPattern ('as' ID)?)?)*
OrPattern <- Closed ('|' Closed)*
Closed <- '*' ID / '-'? NUMBER (/[-+](?!=)/ NUMBER)? / Strings / /(?>None|True|False)(?!\w)/ / '(' Pattern? ')' / '[' Pattern? ']' / '{' ((Test ':' OrPattern / '**' ID) (',' (Test ':' OrPattern / '**' ID))* ','?)? '}' / Dotted ('(' ((ID /=(?!=)/)? OrPattern ('as' ID)? (',' (ID /=(?!=)/)? OrPattern ('as' ID)?)* ','?)? ')')?
Targets <- Target (',' Target)* ','?
Target <- '*' Target / Single / '(' Targets? ')' / '[' Targets? ']'
Params <- (Param (',' Param)* ','?)?
Param <- '\/' / /\*\*?/ (ID (':' StarItem)?)? / ID (':' Test)? (/=(?!=)/ Test)?
LambdaParams <- (LambdaParam (',' LambdaParam)* ','?)?
LambdaParam <- '\/' / /\*\*?/ ID? / ID (/=(?!=)/ Test)?
Star <- StarItem (',' StarItem)* ','?
StarItem <- '*' Or / Named
Named <- ID ':=' Test / Test
Test <- 'lambda' LambdaParams ':' Test / OrTest ('if' OrTest 'else' Test)?
OrTest <- And ('or' And)*
And <- Not ('and' Not)*
Not <- 'not' Not / Compare
Compare <- Or (COMPARE Or)*
COMPARE <- /(?>==|!=|<=|>=|<(?!<)|>(?!>)|not\s+in(?!\w)|in(?!\w)|is\s+not(?!\w)|is(?!\w))/
Or <- Unary (OPERATOR Unary)*
OPERATOR <- /(?>\*\*(?!=)|\/\/(?!=)|<<(?!=)|>>(?!=)|[-+*\/%@&|^](?!=))/
Unary <- /[-+~]/ Unary / 'await'? Primary ('**' Unary)?
Primary <- Atom Suffix*
Suffix <- '(' Args ')' / '[' Subscript (',' Subscript)* ','? ']' / '.' ID
Subscript <- '*' Or / Named? ':' Test? (':' Test?)? / Named
Args <- ((Positional (',' Positional)* (',' Keyword)* / Keyword (',' Keyword)*) ','?)?
Positional <- /\*(?!\*)/ Test / !KEYWORD Named Comp*
KEYWORD <- ~/\w++[ \t\f]*+=(?!=)/
Keyword <- ID /=(?!=)/ Test / /\*\*?/ Test
Comp <- 'async'? 'for' Targets 'in' OrTest ('if' (OrTest !ELSE / Named))*
ELSE <- ~/if(?!\w)[^\n]*else/
Atom <- Strings / ID / NUMBER / /(?>None|True|False)(?!\w)/ / '...' / '(' (Yield / Group)? ')' / '[' NUMBERS? Group? ']' / '{' Braces? '}'
Group <- StarItem (Comp+ / (',' StarItem)* ','?)
Braces <- '**' Or DictRest / Test ':' Test (Comp+ / DictRest) / Group
DictRest <- (',' ('**' Or / Test ':' Test))* ','?
Strings <- (STRING / Formatted)+
Formatted <- @FORMATTED@
@FIELDS@
STRING <- /(?>[uU]|[rR][bB]?+|[bB][rR]?+)?+(?>\"\"\"(?>[^"\\]++|\\.|"(?!""))*+\"\"\"|'''(?>[^'\\]++|\\.|'(?!''))*+'''|"(?>[^"\\\n]++|\\.)*+"|'(?>[^'\\\n]++|\\.)*+')/
NUMBER <- /(?>0[xX](?>_?[\da-fA-F])++|0[bB](?>_?[01])++|0[oO](?>_?[0-7])++|0++(?>_0)*+(?![\d.eEjJ_])|(?>(?>[1-9](?>_?\d)*+|0++(?=[.eEjJ])|\d++(?=\.))(?>\.(?>\d(?>_?\d)*+)?+)?+|\.\d(?>_?\d)*+)(?>[eE][+-]?\d(?>_?\d)*+)?+[jJ]?+)(?!\w)/
""".replace("@KW@", PY_KEYWORDS)
    .replace("@FAST@", _PY_FAST)
    .replace("@FORMATTED@", " / ".join(f"OPEN{k} (TEXT{k} / Field{k})* CLOSE{k}" for k in _FORMATTED))
    .replace("@FIELDS@", "".join(_formatted(k, *x) for k, x in _FORMATTED.items())),
    r"[ \t\f]*+",
)

_PY_QUOTED = r"\"\"\"(?>[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?>[^'\\]++|\\.|'(?!''))*+'''|\"(?>[^\"\\\n]++|\\.)*+\"|'(?>[^'\\\n]++|\\.)*+'"
_PY_INSIDE = r"(?>\{\{|\}\}|(?&field)|\\N\{[A-Z][^{}\n]*+\}|\\[^{}]|\\(?=[{}])|"
PY_PIECE = regex.compile(
    r"(?(DEFINE)(?<field>\{(?>[^{}\"'#]++|(?&formatted)|" + _PY_QUOTED + r"|(?&field)|[\"'#])*+\})(?<formatted>(?<!\w)(?>[fFtT][rR]?+|[rR][fFtT])(?>"
    + rf"\"\"\"{_PY_INSIDE}[^\"\\{{}}]++|\"(?!\"\"))*+\"\"\"|'''{_PY_INSIDE}[^'\\{{}}]++|'(?!''))*+'''|\"{_PY_INSIDE}[^\"\\{{}}\n]++)*+\"|'{_PY_INSIDE}[^'\\{{}}\n]++)*+')))"
    + rf"(?=[fFtTrR\"'#()\[\]{{}}\\\n])(?:(?<f>(?&formatted))|{_PY_QUOTED}|#[^\n]*+|[(\[{{]|[)\]}}]|\\\n|\n[ \t\f]*+)",
    regex.S,
)


def _python_text(text: Moved) -> Moved:
    """Logical lines with indent and dedent marks; comments and blank lines are dropped.

    A dedent to a column that no open block has becomes a mark that no rule takes.
    """
    if "\x01" in text.text or "\x02" in text.text or "\0" in text.text:
        return text.pieces([("\0", 0)])
    text.sub(LINE_END, lambda m: "" if m[0] == "\ufeff" else "\n")
    whole = text.text.rstrip()
    shift = 1  # the line end put before the text
    src = "\n" + whole + "\n"

    def pieces() -> Iterator[tuple[str, int]]:
        stack, depth, at, blank = [0], 0, 0, True
        n = len(src)
        for m in PY_PIECE.finditer(src):
            s = m.start()
            if s > at:
                yield src[at:s], at - shift
            at = m.end()
            c = src[s]
            if c == "\n":
                nxt = src[at] if at < n else ""
                if depth:
                    yield " ", s - shift
                elif nxt and nxt not in "\n#":
                    lead = m[0][1:].rpartition("\f")[2]
                    width = len(lead) if "\t" not in lead else len(lead.expandtabs(8))
                    if not blank:
                        yield "\n", s - shift
                    if width > stack[-1]:
                        stack.append(width)
                        yield "\x01", at - shift
                    else:
                        while width < stack[-1]:
                            stack.pop()
                            yield "\x02", at - shift
                        if width != stack[-1]:
                            yield "\0", at - shift
                    blank = False
            elif m["f"]:  # a line end inside a field doesn't end the statement
                yield m[0].replace("\n", " "), s - shift
            elif c in "#\\":
                yield " ", s - shift
            else:
                if c in "([{":
                    depth += 1
                elif c in ")]}":
                    depth = max(0, depth - 1)
                yield m[0], s - shift
        yield src[at:], at - shift
        yield "\n" + "\x02" * (len(stack) - 1), len(whole)

    text.pieces(pieces())
    if not text.text.strip():
        text.text = ""
    return text


LINE_END = regex.compile(r"\A\ufeff|\r\n?")
PYTHON.prepare = _python_text


BYTE_MARK = regex.compile(r"\A\ufeff")


def _script_text(text: Moved) -> Moved:
    return text.sub(BYTE_MARK, lambda m: "")


for _g in (JS, TS, JAVA):
    _g.prepare = _script_text

#: The grammar of each extension.
BY_EXTENSION = {"json": JSON, "js": JS, "ts": TS, "java": JAVA, "go": GO, "rb": RUBY, "py": PYTHON}
