"""Grammars of the supported dialects, in the notation of `gll.Grammar`.

Token kinds come from `lexers`: words have their own text as kind where it matters
to a grammar, else ID. What a parenthesis or a name before an arrow is, the
recogniser decides by following every reading at once. Parts in %ts{ } hold for
TypeScript only, in %jsx{ } for dialects with JSX only, in %nojsx{ } for those
without. Names in capitals are macros.
"""

from __future__ import annotations

import re
from functools import cache

from quarrylens.llm.syntax.gll import Grammar

# Words of the languages.
ES_RESERVED = (
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if "
    "import in instanceof new null return super switch this throw true try typeof var void while with yield let static await "
    "implements interface package private protected public"
).split()
ES_CONTEXTUAL = (
    "async of get set from as type namespace module declare abstract readonly keyof infer is unique asserts satisfies override "
    "accessor target global require out"
).split()
ES_BINARY = "+ - * / % << & | ^ == != === !== < <= in instanceof".split()
ES_ASSIGN = "= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split()
ES_PREFIX = "! ~ + - ++ -- typeof void delete await".split()

#: Pieces that are written into the rules where their name stands, so that one automaton decides between them.
_ES_MACROS = {
    "ARROWBODY": "( ArrowExpr | Body )",
    # what a target of an assignment may end with, and what it may not end with
    "SELECT": "'.' ( $Name | 'PRIVATE' ) | '[' Expr ']' %ts{ | JOIN '!' }",
    "CALL": "Args | Template | '?.' ( $Name | 'PRIVATE' | Args | '[' Expr ']' %ts{ | TypeArgs Args } ) %ts{ | TypeArgs }",
    "SIMPLE": ("'this' | 'super' | 'null' | 'true' | 'false' | 'NUM' | 'STRING' | 'REGEX' | 'PRIVATE' | Template | Function | Class"
               " | 'import' ( '.' $Name | Args ) | 'new' 'new'* ( '.' 'target' | $Id | NEWABLE ) %jsx{ | Jsx }"),
    "NEWABLE": "'this' | 'super' | 'PRIVATE' | 'STRING' | Template | Function | Class | Array | Object | '(' Expr ')' | 'import' ( '.' $Name | Args )",
    "ID_ASSIGN": ("$Id ( '=>' ARROWBODY | ( ( SELECT | CALL )* ( SELECT ) )? ( $AssignOp Assign | JOIN ( '++' | '--' ) Tail? )"
                  " | ( SELECT | CALL )* Tail? )"),
    "MORE": "$Bin | '>' ( '>' '>'? )? '='?",
    # binary operators: a prefixed operand is not raised to a power, and '??' does not meet '&&' or '||' without parentheses
    "STEPS": "( ( MORE | '**' ) ( Operand | Prefixed ( ( MORE ) Prefixed )* ( MORE ) Operand ) %ts{ | ( 'as' | 'satisfies' ) Type | 'as' 'const' } )*",
    "LAST": "( ( MORE | '**' ) Prefixed ( ( MORE ) Prefixed )* %ts{ ( ( 'as' | 'satisfies' ) Type | 'as' 'const' )* } )?",
    "SEGMENT": "( Operand STEPS LAST | FROM_PREFIX )",
    "FROM_PREFIX": "Prefixed %ts{ ( ( 'as' | 'satisfies' ) Type | 'as' 'const' )* } ( ( MORE ) Prefixed )* ( ( MORE ) Operand STEPS LAST )?",
    "LOGIC": "( ( '??' SEGMENT )* | ( ( '&&' | '||' ) SEGMENT )* )",
    "COND": "'?' Assign ':' Assign",
    "PROPNAME": "( $Name | 'STRING' | 'NUM' | '[' Assign ']' | 'PRIVATE' )",
    "IS": "( 'is' Type )?",
}

_ES = r"""
Module = ModuleItem* 'EOF' ;
ModuleItem = Import | Export | StmtM ;
Import = 'import' ( %ts{ 'type'? }
    ( $Id ( ',' ( NsImport | NamedImports ) )? | NsImport | NamedImports ) 'from' )? 'STRING' ImportAttrs? SEMI
  %ts{ | 'import' 'type'? $Id '=' ( 'require' '(' 'STRING' ')' | EntityName ) SEMI } ;
ImportAttrs = 'with' Object ;
NsImport = '*' 'as' $Id ;
NamedImports = '{' ( ImportSpec ( ',' ImportSpec )* ','? )? '}' ;
ImportSpec = ( $Name | 'STRING' ) ( 'as' ( $Name | 'STRING' ) )? %ts{ | 'type' $Name ( 'as' $Name )? } ;
Export = Decorator* 'export' (
      '*' ( 'as' ( $Name | 'STRING' ) )? 'from' 'STRING' ImportAttrs? SEMI
    | NamedImports ( 'from' 'STRING' ImportAttrs? )? SEMI
    | 'default' ( Function | Class | ExportedExpr SEMI )
    | VarStmt | FunctionDecl | ClassDecl
    %ts{ | TsDecl | 'type' NamedImports ( 'from' 'STRING' ImportAttrs? )? SEMI | 'type' '*' ( 'as' $Name )? 'from' 'STRING' SEMI
      | '=' Expr SEMI | 'as' 'namespace' $Id SEMI | 'default' Interface | 'import' $Id '=' EntityName SEMI | 'default' FunctionHead } ) ;
ExportedExpr = Assign ;
ExprStmt = Expr SEMI ;
VarStmt = ( 'var' | 'let' ) VarDecl ( ',' VarDecl )* SEMI | 'const' ConstDecl ( ',' ConstDecl )* SEMI ;
VarDecl = Binding %ts{ '!'? TypeAnn? } ( '=' Assign )? ;
ConstDecl = Binding %ts{ TypeAnn? } '=' Assign ;
Binding = $Id | ArrayPattern | ObjectPattern ;
ArrayPattern = '[' BindElem? ( ',' BindElem? )* ']' ;
BindElem = '...'? Binding ( '=' Assign )? ;
ObjectPattern = '{' ( BindProp ( ',' BindProp )* ','? )? '}' ;
BindProp = '...' $Id | $Id ( '=' Assign )? | PROPNAME ':' Binding ( '=' Assign )? ;
ForInit = ( 'var' | 'let' ) VarDecl ( ',' VarDecl )* | 'const' ConstDecl ( ',' ConstDecl )* | Expr ;
Body = '{' StmtF* '}' ;
Function = ( 'async' JOIN )? 'function' '*'? $Id? %ts{ TypeParams? } Params %ts{ Ret? } Body ;
FunctionDecl = ( 'async' JOIN )? 'function' '*'? $Id %ts{ TypeParams? } Params %ts{ Ret? } ( Body %ts{ | SEMI } ) ;
%ts{ FunctionHead = ( 'async' JOIN )? 'function' '*'? $Id? TypeParams? Params Ret? SEMI ; }
Params = '(' ( Param ( ',' Param )* ','? )? ')' ;
Param = Decorator* %ts{ $Access* } '...'? ( Binding %ts{ | 'this' } ) %ts{ '?'? TypeAnn? } ( '=' Assign )? ;
Class = Decorator* %ts{ 'abstract'? } 'class' $Id? ClassRest ;
ClassDecl = Decorator* %ts{ 'abstract'? } 'class' $Id ClassRest ;
ClassRest = %ts{ TypeParams? } ( 'extends' Lhs )? %ts{ ( 'implements' Type ( ',' Type )* )? } '{' Member* '}' ;
Member = ';' | 'static' BlockM | Decorator* $Mod* '*'? PROPNAME (
    %ts{ '?'? TypeParams? } Params %ts{ Ret? } ( Body %ts{ | SEMI } )
    | %ts{ ( '?' | '!' )? TypeAnn? } ( '=' Assign )? SEMI )
  %ts{ | $Mod* '[' $Id ':' Type ']' TypeAnn ( SEMI | ',' ) } ;
Decorator = '@' ( $Id ( '.' ( $Name | 'PRIVATE' ) )* Args? | '(' Expr ')' ) ;
Object = '{' ( Prop ( ',' Prop )* ','? )? '}' ;
Prop = '...' Assign | $Id ( '=' Assign )? | PROPNAME ':' Assign | ( 'async' | 'get' | 'set' )* '*'? PROPNAME %ts{ TypeParams? } Params %ts{ Ret? } Body ;
Array = '[' Item? ( ',' Item? )* ']' ;
Item = '...'? Assign ;
Args = '(' ( Item ( ',' Item )* ','? )? ')' ;
Expr = Assign ( ',' Assign )* ;
Assign = Arrow | 'yield' ( '*'? Assign )? | ID_ASSIGN
    | ( Array | Object | '(' Expr ')' | ( SIMPLE | Array | Object | '(' Expr ')' ) ( SELECT | CALL )* ( SELECT ) )
        ( $AssignOp Assign | JOIN ( '++' | '--' ) Tail? )
    | ( SIMPLE | Array | Object | '(' Expr ')' ) ( SELECT | CALL )* Tail?
    | FROM_PREFIX LOGIC ( COND )? ;
Tail = STEPS LAST ( '??' SEGMENT ( '??' SEGMENT )* | ( '&&' | '||' ) SEGMENT ( ( '&&' | '||' ) SEGMENT )* ) ( COND )?
    | ( MORE | '**' ) ( Operand STEPS LAST | Prefixed ( ( MORE ) Prefixed )* ( ( MORE ) Operand STEPS LAST )? ) ( COND )?
    %ts{ | ( ( 'as' | 'satisfies' ) Type | 'as' 'const' ) STEPS LAST ( COND )? }
    | COND ;
Operand = ( $Id | SIMPLE | Array | Object | '(' Expr ')' ) ( SELECT | CALL )* ( JOIN ( '++' | '--' ) )? ;
Prefixed = $Prefix ( Operand | Prefixed ) %ts{ %nojsx{ | '<' Type '>' ( Operand | Prefixed | Arrow ) } } ;
Lhs = ( $Id | SIMPLE | Array | Object | '(' Expr ')' ) ( SELECT | CALL )* ;
Arrow = ( 'async' JOIN )? ( %ts{ TypeParams? } Params %ts{ Ret? } | 'async' JOIN $Id ) '=>' ARROWBODY ;
ArrowExpr = Assign ;
Template = 'TPL' | 'THEAD' Expr ( 'TMID' Expr )* 'TTAIL' ;
%jsx{
Jsx = 'J<' ( 'JNAME' %ts{ TypeArgs? } ( JAttr )* )? ( 'J/>' | 'J>' JChild* 'J</' 'JNAME'? 'J>' ) ;
JAttr = 'JNAME' ( 'J=' ( 'STRING' | '{' Assign '}' | Jsx ) )? | '{' '...' Assign '}' ;
JChild = 'JTEXT' | Jsx | '{' ( '...'? Expr )? '}' ; }
%ts{
TypeAnn = ':' Type ;
Ret = ':' ( Type IS | 'asserts' ( $Id | 'this' ) IS ) ;
Type = 'abstract'? 'new'? TypeParams? Params '=>' ( Type IS | 'asserts' ( $Id | 'this' ) IS )
   | Union ( 'extends' Union '?' Type ':' Type )? ;
Union = ( '|' | '&' )? TypeTerm ( ( '|' | '&' ) TypeTerm )* ;
TypeTerm = ( 'keyof' | 'unique' | 'readonly' )* ( TypePrim ( JOIN '[' Type? ']' )* | 'infer' $Id ( 'extends' Union )? ) ;
TypePrim = EntityName TypeArgs? | 'typeof' ( EntityName | 'import' '(' Type ')' ( '.' $Name )* ) TypeArgs? | 'this' | 'void' | 'null'
   | 'true' | 'false' | 'STRING' | '-'? 'NUM' | 'TPL' | 'THEAD' Type ( 'TMID' Type )* 'TTAIL' | TypeLit
   | '[' ( TupleEl ( ',' TupleEl )* ','? )? ']' | '(' Type ')' | 'import' '(' Type ( ',' Object )? ')' ( '.' $Name )* TypeArgs? ;
EntityName = ( $Id | 'this' ) ( '.' ( $Name | 'PRIVATE' ) )* ;
TupleEl = '...'? ( $Name '?'? ':' )? Type '?'? ;
TypeLit = '{' ( TypeMember ( ( ';' | ',' | ASI ) TypeMember )* ( ';' | ',' )? )? '}'
   | '{' ( ( '+' | '-' )? 'readonly' )? '[' $Id 'in' Type ( 'as' Type )? ']' ( ( '+' | '-' )? '?' )? TypeAnn? ';'? '}' ;
TypeMember = ( 'readonly' | 'get' | 'set' )* PROPNAME '?'? ( TypeAnn | TypeParams? Params Ret? )? | TypeParams? Params Ret?
   | 'new' TypeParams? Params Ret? | ( 'readonly' | 'static' )* '[' $Id ':' Type ']' TypeAnn ;
TypeArgs = ( '<' | '<<' TypeParams? Params '=>' Type ','? ) ( Type ( ',' Type )* )? '>' ;
TypeParams = '<' TypeParam ( ',' TypeParam )* ','? '>' ;
TypeParam = ( 'const' | 'in' | 'out' )* $Id ( 'extends' Type )? ( '=' Type )? ;
Interface = 'interface' $Id TypeParams? ( 'extends' Type ( ',' Type )* )? TypeLit ;
TsDecl = Interface | 'type' $Id TypeParams? '=' Type SEMI | 'const'? 'enum' $Id '{' ( EnumMember ( ',' EnumMember )* ','? )? '}'
   | ( 'namespace' | 'module' ) ( EntityName | 'STRING' ) ( '{' ModuleItem* '}' | SEMI ) | 'global' '{' ModuleItem* '}'
   | 'declare' ( ( 'var' | 'let' | 'const' ) VarDecl ( ',' VarDecl )* SEMI | FunctionDecl | ClassDecl | TsDecl ) ;
EnumMember = PROPNAME ( '=' Assign )? ; }
"""

#: Statements by where they stand: M at module level, F in a function; L in a loop, W in a switch. ~ is the place itself, ~L a loop there.
_ES_STATEMENTS = r"""
Stmt~ = Block~ | VarStmt | ';' | If~ | For~ | 'while' '(' Expr ')' Stmt~L | 'do' Stmt~L 'while' '(' Expr ')' ';'?
    | JUMPS | 'throw' JOIN Expr SEMI | Try~ | Switch~ | 'debugger' SEMI
    | $Id ':' Stmt~ | ID_ASSIGN ( ',' Assign )* SEMI | FunctionDecl | ClassDecl | ExprStmt %ts{ | TsDecl } ;
Block~ = '{' Stmt~* '}' ;
If~ = 'if' '(' Expr ')' Stmt~ ( 'else' Stmt~ )? ;
For~ = 'for' 'await'? '(' ( ForInit? ';' Expr? ';' Expr?
    | ( ( 'var' | 'let' | 'const' ) Binding | Lhs ) ( 'of' Assign | 'in' Expr ) ) ')' Stmt~L ;
Try~ = 'try' Block~ ( 'catch' ( '(' Binding %ts{ TypeAnn? } ')' )? Block~ ( 'finally' Block~ )? | 'finally' Block~ ) ;
Switch~ = 'switch' '(' Expr ')' '{' ( ( 'case' Expr | 'default' ) ':' Stmt~W* )* '}' ;
"""
_PLACES = {"M": ("ML", "MW"), "ML": ("ML", "ML"), "MW": ("ML", "MW"), "F": ("FL", "FW"), "FL": ("FL", "FL"), "FW": ("FL", "FW")}


def _statements() -> str:
    rules = []
    for place, (loop, switch) in _PLACES.items():
        jumps = ["'break' ( JOIN $Id )? SEMI" if place[1:] else "'break' JOIN $Id SEMI"]
        if place[1:] == "L":
            jumps.append("'continue' ( JOIN $Id )? SEMI")
        if place[0] == "F":
            jumps.append("'return' ( JOIN Expr )? SEMI")
        rules.append(_ES_STATEMENTS.replace("JUMPS", " | ".join(jumps)).replace("~L", loop).replace("~W", switch).replace("~", place))
    return "\n".join(rules)


JAVA_RESERVED = (
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
    "float for goto if implements import instanceof int interface long native new package private protected public return short "
    "static strictfp super switch synchronized this throw throws transient try void volatile while null true false _"
).split()
JAVA_CONTEXTUAL = (
    "record sealed permits var yield module open requires exports opens uses provides to with transitive"
).split()

_JAVA_MACROS = {
    "MODS": "( Annotation | $Mod )*",
    "SUFFIX": ("'.' ( TypeArgs? $Id | 'this' | 'class' | 'super' | New ) | Args | '[' Expr ']' | ( '[' ']' ) ( '[' ']' )* ( '.' 'class' | '::' 'new' )"
               " | TypeArgs? ( '[' ']' )* '::' TypeArgs? ( $Id | 'new' )"),
    "PRIMARY": "$Literal | 'this' | 'super' | '(' Expr ')' | New | PrimClass | Switch",
    "ASSIGNED": "( $AssignOp | '>' '>' '>'? '=' ) Expr",
    "LAMBDA": "'->' ( Expr | Block )",
    # what makes an expression a statement
    "ACT": "( ( SUFFIX )* ( Args | '++' | '--' | ASSIGNED ) | ( SUFFIX )* '.' New )",
    "DECLARED": "Dims? ( '=' VarInit )? ( ',' VarDeclr )*",
}

_JAVA = r"""
Unit = ( Package ( ImportDecl | ';' )* | ( ImportDecl | ';' )+ )? TypeDecl* 'EOF' ;
ModuleUnit = ImportDecl* Annotation* 'open'? 'module' QName '{' Directive* '}' 'EOF' ;
Directive = ( 'requires' ( 'transitive' | 'static' )* QName | ( 'exports' | 'opens' ) QName ( 'to' QName ( ',' QName )* )?
    | 'uses' QName | 'provides' QName 'with' QName ( ',' QName )* ) ';' ;
QName = $Id ( '.' $Id )* ;
Package = Annotation* 'package' QName ';' ;
ImportDecl = 'import' 'static'? QName ( '.' '*' )? ';' ;
TypeDecl = MODS TypeCore | ';' ;
TypeCore = 'class' $Id TypeParams? ( 'extends' Type )? Implements? Permits? Body
    | 'enum' $Id Implements? '{' ( EnumConst ( ',' EnumConst )* )? ','? ( ';' Member* )? '}'
    | 'interface' $Id TypeParams? ( 'extends' TypeList )? Permits? Body
    | 'record' $Id TypeParams? '(' ( Param ( ',' Param )* )? ')' Implements? Body
    | '@' 'interface' $Id Body ;
Implements = 'implements' TypeList ;
Permits = 'permits' TypeList ;
TypeList = Type ( ',' Type )* ;
EnumConst = Annotation* $Id Args? Body? ;
Annotation = '@' QName ( '(' ( AnnArg ( ',' AnnArg )* )? ')' )? ;
AnnArg = ( $Id '=' )? ElemValue ;
ElemValue = Expr | Annotation | '{' ( ElemValue ( ',' ElemValue )* )? ','? '}' ;
Body = '{' Member* '}' ;
Member = ';' | 'static'? Block | MODS ( TypeCore
    | TypeParams? ( Type | 'void' ) $Id Params Dims? Throws? ( Block | ';' | 'default' ElemValue ';' )
    | Type $Id DECLARED ';' | TypeParams? $Id Params Throws? Block | $Id Block ) ;
Throws = 'throws' TypeList ;
Params = '(' ( Param ( ',' Param )* )? ')' ;
Param = MODS Type ( Annotation* '...' )? ( $Id ( '.' 'this' )? Dims? | 'this' ) ;
Type = Annotation* ( $Prim | ClassType ) Dims? ;
ClassType = $Id TypeArgs? ( '.' Annotation* $Id TypeArgs? )* ;
Dims = ( Annotation* '[' ']' )+ ;
TypeArgs = '<' ( TypeArg ( ',' TypeArg )* )? '>' ;
TypeArg = Type | Annotation* '?' ( ( 'extends' | 'super' ) Type )? ;
TypeParams = '<' TypeParam ( ',' TypeParam )* '>' ;
TypeParam = Annotation* $Id ( 'extends' Type ( '&' Type )* )? ;
Block = '{' BlockStmt* '}' ;
BlockStmt = MODS TypeCore | ( Annotation | $Mod ) MODS Type VarDeclr ( ',' VarDeclr )* ';'
    | $Prim Dims? $Id DECLARED ';' | Stmt
    | $Id ( ':' Stmt | ( '.' $Id )* ( TypeArgs ( '.' Annotation* $Id TypeArgs? )* )? Dims? $Id DECLARED ';' | ACT ';' ) ;
LocalVar = MODS Type VarDeclr ( ',' VarDeclr )* ;
VarDeclr = $Id Dims? ( '=' VarInit )? ;
VarInit = Expr | ArrayInit ;
ArrayInit = '{' ( VarInit ( ',' VarInit )* )? ','? '}' ;
SubStmt = Stmt | $Id ( ':' SubStmt | ACT ';' ) ;
Stmt = Block | ';' | 'if' Par SubStmt ( 'else' SubStmt )? | 'while' Par SubStmt | 'do' SubStmt 'while' Par ';' | For | Try | Switch
    | 'synchronized' Par Block | 'return' Expr? ';' | 'throw' Expr ';' | ( 'break' | 'continue' ) $Id? ';'
    | 'assert' Expr ( ':' Expr )? ';' | 'yield' Expr ';' | StmtExprX ';' ;
Par = '(' Expr ')' ;
For = 'for' '(' ( ( LocalVar | StmtExpr ( ',' StmtExpr )* )? ';' Expr? ';' ( StmtExpr ( ',' StmtExpr )* )?
    | MODS Type $Id ':' Expr ) ')' SubStmt ;
Try = 'try' ( Block ( Catch+ ( 'finally' Block )? | 'finally' Block ) | Resources Block Catch* ( 'finally' Block )? ) ;
Resources = '(' Resource ( ';' Resource )* ';'? ')' ;
Resource = MODS Type $Id '=' Expr | Expr ;
Catch = 'catch' '(' MODS Type ( '|' Type )* $Id ')' Block ;
Switch = 'switch' Par '{' ( SwitchLabel ( ':' BlockStmt* | '->' ( Expr ';' | Block | 'throw' Expr ';' ) ) )* '}' ;
SwitchLabel = 'case' CaseItem ( ',' CaseItem )* | 'default' ;
CaseItem = CaseExpr | 'default' ;
CaseExpr = ( $Prefix | Cast )* ( $Id | PRIMARY ) ( SUFFIX )* ( InfixTail )* ( '?' Expr ':' Expr )? ;
InfixTail = ( $Binary | '>' ( '>' '>'? )? '='? ) Unary | 'instanceof' 'final'? Type $Id? ;
Expr = Unary ( InfixTail )* ( '?' Expr ':' Expr | $AssignOp Expr )? ;
StmtExpr = $Id ACT | StmtExprX ;
StmtExprX = ( '++' | '--' ) Unary | ( 'this' | 'super' | '(' Expr ')' | 'STRING' | 'BLOCKSTR' | PrimClass | 'CHAR' ) ACT | New ( SUFFIX )* | New ACT ;
Lambda = '(' ( Param ( ',' Param )* | $Id ( ',' $Id )* )? ')' LAMBDA ;
Unary = ( $Prefix | Cast )* ( $Id ( LAMBDA | ( SUFFIX )* ( '++' | '--' )* ) | ( PRIMARY ) ( SUFFIX )* ( '++' | '--' )* | Lambda ) ;
Cast = '(' Type ( '&' Type )* ')' ;
PrimClass = ( $Prim | 'void' ) ( '[' ']' )* ( '.' 'class' | '::' 'new' ) ;
New = 'new' Annotation* TypeArgs? ( ClassType Args Body? | ( ClassType | $Prim ) ( ( '[' Expr ']' )+ ( '[' ']' )* | ( '[' ']' )+ ArrayInit ) ) ;
Args = '(' ( Expr ( ',' Expr )* )? ')' ;
"""


def _written_out(text: str, macros: dict[str, str], flags: frozenset[str] = frozenset()) -> str:
    """Rules with their macros written in and with the parts of other dialects, %flag{ ... }, left out."""
    names = re.compile(r"\b(?:" + "|".join(sorted(macros, key=len, reverse=True)) + r")\b")
    while names.search(text):
        text = names.sub(lambda m: macros[m.group()], text)
    inner = re.compile(r"%(\w+)\{((?:[^{}%]|'[{}%]=?'|\{(?=')|\}(?='))*?)\}(?!')")
    while inner.search(text):
        text = inner.sub(lambda m: m.group(2) if m.group(1) in flags else "", text)
    return text.replace("SEMI", "( ';' | ASI )").replace("ASI", "'<asi>'").replace("JOIN", "'<join>'")


@cache
def ecmascript(typescript: bool, jsx: bool) -> Grammar:
    flags = frozenset({"ts" if typescript else "js", "jsx" if jsx else "nojsx"})
    ids = ["ID", *ES_CONTEXTUAL]
    return Grammar(
        _written_out(_ES + _statements(), _ES_MACROS, flags),
        {
            "Id": ids,
            "Name": [*ids, *ES_RESERVED],
            "Mod": ["static", "async", "get", "set", "accessor", *(
                "public private protected readonly abstract override declare".split() if typescript else [])],
            "Access": "public private protected readonly override".split(),
            "Bin": ES_BINARY, "AssignOp": ES_ASSIGN, "Prefix": ES_PREFIX,
        },
        {"ExprStmt": {"{", "function", "class", "@", *ids} - {"async"}, "ArrowExpr": {"{"}, "ExportedExpr": {"function", "class", "@"}},
    )


@cache
def java() -> Grammar:
    return Grammar(
        _written_out(_JAVA, _JAVA_MACROS),
        {
            "Id": ["ID", *JAVA_CONTEXTUAL],
            "Mod": ("public protected private static abstract final native synchronized transient volatile strictfp default "
                    "sealed non-sealed").split(),
            "Prim": "byte short int long char float double boolean".split(),
            "Literal": ["NUM", "CHAR", "STRING", "BLOCKSTR", "true", "false", "null"],
            "Binary": "+ - * / % << & | ^ && || == != < <=".split(),
            "AssignOp": "= += -= *= /= %= <<= &= |= ^=".split(),
            "Prefix": "! ~ + - ++ --".split(),
        },
    )


#: Extension -> (grammar maker, start rules run together).
DIALECTS = {
    ".java": (java, ("Unit", "ModuleUnit")),
    ".js": (lambda: ecmascript(False, False), ("Module",)),
    ".jsx": (lambda: ecmascript(False, True), ("Module",)),
    ".ts": (lambda: ecmascript(True, False), ("Module",)),
    ".tsx": (lambda: ecmascript(True, True), ("Module",)),
}
