"""Parsing-expression grammars of five languages, over token kinds.

Bracketed parts in braces were parsed before and stand as one terminal, written {Class}. Where a grammar is wider than
its language it is so on purpose: it judges what a parser judges, not what a type checker or a later pass rejects.
"""

ECMASCRIPT = r"""
Module <- Item* END
StmtList <- Stmt* END
Item <- Import / Export / Stmt
Import <- 'import' ( STR / 'type'? ImportNames 'from' STR / 'type' ImportNames 'from' STR ) With? Eos
ImportNames <- Id ( ',' ( '*' 'as' Id / {Specs} ) )? / '*' 'as' Id / {Specs}
With <- ( 'with' / 'assert' ) {Object}
Export <- 'export' ( 'default' ( Func / Class / Assign Eos ) / '*' ( 'as' ( AnyName / STR ) )? 'from' STR With? Eos / {Specs} ( 'from' STR With? )? Eos / Declared )
Declared <- VarStmt / FuncDecl / ClassDecl
FuncDecl <- &( ( 'async' HERE )? 'function' '*'? Id ) Func
ClassDecl <- &( Decorator* 'class' ClassName ) Class
Specs <- ( Spec ( ',' Spec )* ','? )? END
Spec <- ( AnyName / STR ) ( 'as' ( AnyName / STR ) )?
Stmt <- {Block} / ';' / VarStmt / FuncDecl / ClassDecl / If / For / While / DoWhile / Switch / Try / Return / Jump / Throw / Debugger / Label / !( {Object} / 'function' / 'class' ) Expr Eos
Eos <- HERE ';' / BREAK / END / ';'
VarStmt <- Variables Eos
Variables <- 'const' ConstDecl ( ',' ConstDecl )* / ( 'var' / 'let' ) VarDecl ( ',' VarDecl )*
ConstDecl <- Binding Typed? '=' Assign
VarDecl <- Binding Typed? ( '=' Assign )?
Binding <- Id / {Object} / '[' ( ','* ( '...'? Binding Typed? ( '=' Assign )? ','* )* ) ']'
Typed <- NEVER
If <- 'if' '(' Expr ')' Stmt ( 'else' Stmt )?
For <- 'for' 'await'? '(' ( ForEach / ForInit? ';' Expr? ';' Expr? ) ')' Stmt
ForEach <- ( ( 'var' / 'let' / 'const' ) Binding / Lhs / {Object} ) ( 'of' Assign / 'in' Expr ) &')'
ForInit <- Variables / Expr
While <- 'while' '(' Expr ')' Stmt
DoWhile <- 'do' Stmt 'while' '(' Expr ')' ';'?
Switch <- 'switch' '(' Expr ')' {SwitchBody}
SwitchBody <- ( ( 'case' Expr / 'default' ) ':' Stmt* )* END
Try <- 'try' {Block} ( 'catch' ( '(' Binding Typed? ')' )? {Block} ( 'finally' {Block} )? / 'finally' {Block} )
Return <- 'return' ( HERE Expr )? Eos
Jump <- ( 'break' / 'continue' ) ( HERE Id )? Eos
Throw <- 'throw' HERE Expr Eos
Debugger <- 'debugger' Eos
Label <- Id ':' Stmt
Func <- ( 'async' HERE )? 'function' '*'? Id? Signature {Block}
Signature <- '(' Params? ')'
Params <- Param ( ',' Param )* ','?
Param <- '...'? Binding Typed? ( '=' Assign )?
Class <- Decorator* 'class' ClassName? ( 'extends' Lhs )? {ClassBody}
ClassName <- !'extends' Id
Decorator <- '@' Id ( '.' AnyName )* Args?
ClassBody <- Member* END
Member <- ';' / Decorator* 'static' {Block} / Decorator* Mods Key Signature {Block} / Decorator* Mods Key ( '=' Assign )? Eos
Mods <- ( ( 'static' / 'async' / 'get' / 'set' ) &( '*' / Key ) )* '*'?
Key <- AnyName / STR / NUM / PRIV / '[' Assign ']'
Object <- ( Prop ( ',' Prop )* ','? )? END
Prop <- '...' Assign / Mods Key Signature {Block} / Key ':' Assign / Id ( '=' Assign )?
Expr <- Assign ( ',' Assign )*
Assign <- Arrow / 'yield' ( HERE '*' Assign / HERE Assign )? / AssignTarget AssignOp Assign / Cond
AssignTarget <- {Object} / '[' Elements ']' !SuffixStart / Target
Target <- Primary ( Suffix &Suffix )* ( '.' ( AnyName / PRIV ) / '[' Expr ']' ) !SuffixStart / Id !SuffixStart / '(' Target ')' !SuffixStart
SuffixStart <- '.' / '?.' / '[' / '(' / TPL
AssignOp <- ASSIGNOP / '>' '>' '>' '=' / '>' '>' '='
Arrow <- ( 'async' HERE )? ( Id / Signature ) HERE '=>' ( {Block} / Assign )
Cond <- Binary ( '?' Assign ':' Assign )?
Binary <- Unary ( BinOp Unary )*
BinOp <- BINOP / 'in' / 'instanceof' / '>' '>' '>' !'=' / '>' '>' !( '=' / '>' ) / '>' '=' / '>' !'>'
Unary <- UNARYOP Unary / ( '++' / '--' ) Target / ( 'typeof' / 'void' / 'delete' / 'await' ) Unary / PRIV &'in' / Postfix
Postfix <- Target HERE ( '++' / '--' ) / Lhs
Lhs <- Primary Suffix*
Suffix <- '.' ( AnyName / PRIV ) / '?.' ( AnyName / PRIV / Args / '[' Expr ']' ) / '[' Expr ']' / Args / TPL
Args <- '(' ( Arg ( ',' Arg )* ','? )? ')'
Arg <- '...'? Assign
Primary <- New / STR / NUM / TPL / RE / 'this' / 'super' / 'null' / 'true' / 'false' / Func / Class / 'import' ( '.' AnyName / &'(' ) / '(' Expr ')' / '[' Elements ']' / {Object} / Id
New <- 'new' ( '.' AnyName / NewTarget Args? )
NewTarget <- ( New / Primary ) ( '.' ( AnyName / PRIV ) / '[' Expr ']' / TPL )*
Elements <- ( ','+ / Arg ( ',' / &']' ) )*
Id <- NAME
AnyName <- NAME / KEYWORD
"""

#: What TypeScript adds or changes; the rest is ECMASCRIPT.
TYPESCRIPT = r"""
Item <- Import / ImportEquals / Export / Stmt
ImportEquals <- 'import' Id '=' ( 'require' Args / TypeName ) Eos
Export <- 'export' ( '=' Expr Eos / 'as' 'namespace' Id Eos / 'default' ( Func / 'abstract'? Class / Interface / Assign Eos ) / '*' ( 'as' ( AnyName / STR ) )? 'from' STR With? Eos / 'type'? {Specs} ( 'from' STR With? )? Eos / 'import' Id '=' TypeName Eos / Declared )
Spec <- ( 'type' &( AnyName !( ',' / END ) / STR ) )? ( AnyName / STR ) ( 'as' ( AnyName / STR ) )?
Declared <- VarStmt / FuncDecl / ClassDecl / Decl
ClassDecl <- &( Decorator* 'abstract'? 'class' ClassName ) Class
Decl <- 'declare' Declared / 'declare' 'global' {Module} / 'abstract' Class / Interface / Alias / Enum / Namespace
Interface <- 'interface' Id Generics? ( 'extends' Type ( ',' Type )* )? {TypeBody}
Alias <- 'type' HERE Id Generics? '=' Type Eos
Enum <- 'const'? 'enum' Id {EnumBody}
EnumBody <- ( EnumItem ( ',' EnumItem )* ','? )? END
EnumItem <- ( AnyName / STR / '[' Assign ']' ) ( '=' Assign )?
Namespace <- ( 'namespace' / 'module' ) ( STR / Id ( '.' Id )* ) ( {Module} / Eos )
Stmt <- {Block} / ';' / Enum / VarStmt / FuncDecl / ClassDecl / Decl / If / For / While / DoWhile / Switch / Try / Return / Jump / Throw / Debugger / Label / !( {Object} / 'function' / 'class' ) Expr Eos
ConstDecl <- VarDecl
AssignTarget <- Cond
Postfix <- Lhs ( HERE ( '++' / '--' ) )?
Typed <- '?' ':' Type / '!' ':' Type / ':' Type / '?'
Func <- ( 'async' HERE )? 'function' '*'? Id? Signature ( {Block} / Eos )
Signature <- Generics? '(' Params? ')' ( ':' Predicate )?
Predicate <- 'asserts' ( Id / 'this' ) ( 'is' Type )? / ( Id / 'this' ) 'is' Type / Type
Param <- Decorator* ( ( 'public' / 'private' / 'protected' / 'readonly' / 'override' ) &( Id / {Object} ) )* '...'? ( Binding / 'this' ) Typed? ( '=' Assign )?
Class <- Decorator* 'abstract'? 'class' ClassName? Generics? ( 'extends' Lhs TypeArgs? )? ( 'implements' Type ( ',' Type )* )? {ClassBody}
ClassName <- !( 'extends' / 'implements' ) Id
Member <- ';' / Decorator* 'static' {Block} / IndexSig Eos / Decorator* Mods Key ( '?' / '!' )? Signature ( {Block} / Eos ) / Decorator* Mods Key ( '?' / '!' )? ( ':' Type )? ( '=' Assign )? Eos
IndexSig <- Mods '[' Id ':' Type ']' ':' Type
Mods <- ( ( 'static' / 'async' / 'get' / 'set' / 'public' / 'private' / 'protected' / 'readonly' / 'abstract' / 'override' / 'declare' / 'accessor' ) &( '*' / Key ) )* '*'?
TypeBody <- ( TypeMember ( ';' / ',' / BREAK / &END ) )* END
TypeMember <- Mapped / IndexSig / 'new' Signature / Signature / Mods Key '?'? Signature / Mods Key '?'? ( ':' Type )?
Mapped <- ( ( '+' / '-' )? 'readonly' )? '[' Id 'in' Type ( 'as' Type )? ']' ( ( '+' / '-' )? '?' )? ( ':' Type )?
Generics <- '<' Generic ( ',' Generic )* ','? '>'
Generic <- ( ( 'const' / 'in' / 'out' ) &Id )* Id ( 'extends' Type )? ( '=' Type )?
TypeArgs <- '<' Type ( ',' Type )* '>'
Type <- FuncType / Union ( HERE 'extends' Union '?' Type ':' Type )?
FuncType <- 'abstract'? 'new'? Generics? '(' Params? ')' '=>' Predicate
Union <- '|'? Inter ( '|' Inter )*
Inter <- '&'? TypeUnary ( '&' TypeUnary )*
TypeUnary <- ( 'keyof' / 'unique' / 'readonly' ) TypeUnary / 'infer' Id ( 'extends' Union !'?' )? / TypePost
TypePost <- TypeAtom ( HERE '[' Type? ']' )*
TypeAtom <- '(' Type ')' / {TypeBody} / '[' ( TupleItem ( ',' TupleItem )* ','? )? ']' / 'typeof' ( 'import' Args / Id / 'this' ) ( '.' AnyName )* TypeArgs? / 'import' '(' Type ')' ( '.' AnyName )* TypeArgs? / 'void' / 'null' / 'this' / 'true' / 'false' / '-'? NUM / STR / TPL / TypeName TypeArgs?
TupleItem <- '...'? ( AnyName '?'? ':' )? Type '?'?
TypeName <- Id ( '.' AnyName )*
Arrow <- ( 'async' HERE )? ( Id / Signature ) HERE '=>' ( {Block} / Assign )
Binary <- Unary ( HERE ( 'as' / 'satisfies' ) ( 'const' / Type ) / BinOp Unary )*
Unary <- ( UNARYOP / '++' / '--' ) Unary / ( 'typeof' / 'void' / 'delete' / 'await' ) Unary / PRIV &'in' / '<' ( 'const' / Type ) '>' Unary / Postfix
Suffix <- '.' ( AnyName / PRIV ) / '?.' ( AnyName / PRIV / TypeArgs? Args / '[' Expr ']' ) / HERE '!' !'=' / '[' Expr ']' / Args / TPL / TypeArgs ( Args / TPL )
New <- 'new' ( '.' AnyName / NewTarget TypeArgs? Args? )
"""

JAVA = r"""
Unit <- ( Annotation* 'package' Name ';' )? ( ';' / Import )* ( ';' / TypeDecl )* END
Import <- 'import' 'static'? Name ( '.' '*' )? ';'
Name <- Id ( '.' Id )*
TypeDecl <- Mods ( ClassDecl / InterfaceDecl / EnumDecl / RecordDecl / AnnotationDecl )
Mods <- ( Annotation / MODIFIER / 'default' !':' / 'sealed' &( Mods ( 'class' / 'interface' ) ) / 'non' '-' 'sealed' )*
Annotation <- '@' !'interface' Name ( '(' ( AnnotationArg ( ',' AnnotationArg )* )? ')' )?
AnnotationArg <- ( Id '=' )? AnnotationValue
AnnotationValue <- Annotation / {ArrayInit} / Cond
ClassDecl <- 'class' Id TypeParams? ( 'extends' Type )? ( 'implements' Types )? ( 'permits' Types )? {ClassBody}
InterfaceDecl <- 'interface' Id TypeParams? ( 'extends' Types )? ( 'permits' Types )? {ClassBody}
RecordDecl <- 'record' Id TypeParams? '(' Params? ')' ( 'implements' Types )? {ClassBody}
EnumDecl <- 'enum' Id ( 'implements' Types )? {EnumBody}
AnnotationDecl <- '@' 'interface' Id {ClassBody}
EnumBody <- ( EnumConst ( ',' EnumConst )* )? ','? ( ';' Member* )? END
EnumConst <- Annotation* Id Args? {ClassBody}?
ClassBody <- Member* END
Member <- ';' / 'static'? {Block} / TypeDecl / Mods ( Method / Constructor / Field )
Method <- TypeParams? Type Id '(' Params? ')' Dims ( 'throws' Types )? ( 'default' AnnotationValue )? ( {Block} / ';' )
Constructor <- TypeParams? Id ( '(' Params? ')' )? ( 'throws' Types )? {Block}
Field <- Type Declarator ( ',' Declarator )* ';'
Declarator <- Id Dims ( '=' Init )?
Init <- {ArrayInit} / Expr
ArrayInit <- ( AnnotationOrInit ( ',' AnnotationOrInit )* )? ','? END
AnnotationOrInit <- Annotation / Init
Params <- Param ( ',' Param )*
Param <- Mods Type ( Annotation* '...' )? ( ( Id '.' )? 'this' / Id ) Dims
TypeParams <- '<' TypeParam ( ',' TypeParam )* '>'
TypeParam <- Annotation* Id ( 'extends' Type ( '&' Type )* )?
Types <- Type ( ',' Type )*
Type <- Annotation* ( PRIMITIVE / ClassType ) ( Annotation* '[' ']' )*
ClassType <- Id TypeArgs? ( '.' Annotation* Id TypeArgs? )*
TypeArgs <- '<' ( TypeArg ( ',' TypeArg )* )? '>'
TypeArg <- Annotation* '?' ( ( 'extends' / 'super' ) Type )? / Type
Dims <- ( '[' ']' )*
StmtList <- Stmt* END
Stmt <- {Block} / ';' / If / For / While / DoWhile / Switch Yielded? / Try / Sync / Return / Throw / Jump / Yield / Assert / Label / LocalType / Local ';' / ThisCall / Effect ';'
Effect <- Target AssignOp Expr / ( '++' / '--' ) Unary / Target ( '++' / '--' ) / Call
Target <- Primary ( Suffix &Suffix )* ( '.' Id !'(' / '[' Expr ']' ) !SuffixStart / Id !SuffixStart / '(' Target ')' !SuffixStart
Call <- ( Id Args / 'new' Creator ) !SuffixStart / Primary ( Suffix &Suffix )* '.' ( TypeArgs? Id Args / 'super' Args / 'new' Creator ) !SuffixStart
SuffixStart <- '.' / '[' / '::' / '('
LocalType <- Mods ( ClassDecl / InterfaceDecl / EnumDecl / RecordDecl )
Local <- Mods Type Declarator ( ',' Declarator )*
ThisCall <- ( 'this' / 'super' ) Args ';'
Yielded <- Suffix+ ';'
If <- 'if' '(' Expr ')' Stmt ( 'else' Stmt )?
For <- 'for' '(' ( Mods Type Id ':' Expr / ( Local / Exprs )? ';' Expr? ';' Exprs? ) ')' Stmt
Exprs <- Expr ( ',' Expr )*
While <- 'while' '(' Expr ')' Stmt
DoWhile <- 'do' Stmt 'while' '(' Expr ')' ';'
Switch <- 'switch' '(' Expr ')' {SwitchBody}
SwitchBody <- ( SwitchLabel '->' ( {Block} / Throw / Expr ';' ) )* END / ( ( SwitchLabel ':' )+ Stmt* )* END
SwitchLabel <- 'case' CaseItem ( ',' CaseItem )* ( NAMEWHEN Cond )? / 'default'
CaseItem <- 'default' / Pattern / Cond
Pattern <- Mods Type ( '(' ( Pattern ( ',' Pattern )* )? ')' Id? / Id )
Try <- 'try' ( '(' Resource ( ';' Resource )* ';'? ')' {Block} Catch* Finally? / {Block} ( Catch+ Finally? / Finally ) )
Resource <- Mods Type Id '=' Expr / Postfix
Catch <- 'catch' '(' Mods Type ( '|' Type )* Id ')' {Block}
Finally <- 'finally' {Block}
Sync <- 'synchronized' '(' Expr ')' {Block}
Return <- 'return' Expr? ';'
Throw <- 'throw' Expr ';'
Jump <- ( 'break' / 'continue' ) Id? ';'
Yield <- 'yield' !( '=' / '.' / '(' ) Expr ';'
Assert <- 'assert' Expr ( ':' Expr )? ';'
Label <- Id ':' Stmt
Expr <- Lambda / Target AssignOp Expr / Cond
AssignOp <- ASSIGNOP / '>' '>=' / '>' '>' '>='
Lambda <- ( Id / '(' ( LambdaParams / Params )? ')' ) '->' ( {Block} / Expr )
LambdaParams <- Id ( ',' Id )* &')'
Cond <- Binary ( '?' Expr ':' ( Lambda / Cond ) )?
Binary <- Unary ( 'instanceof' ( 'final'? Pattern / Type ) / BinOp Unary )*
BinOp <- BINOP / '>' '>' '>' / '>' '>' / '>'
Unary <- UNARYOP Unary / Cast / Postfix
Cast <- '(' PRIMITIVE Dims ')' Unary / '(' Type ( '&' Type )* ')' ( Lambda / &( Id / LITERAL / 'this' / 'super' / 'new' / '(' / '!' / '~' / PRIMITIVE / 'switch' ) Unary )
Postfix <- Primary Suffix* ( '++' / '--' )*
Suffix <- '.' ( 'new' Creator / TypeArgs? ( Id / 'super' ) Args? / 'this' / 'class' ) / '[' Expr ']' / '::' TypeArgs? ( Id / 'new' )
Primary <- LITERAL / 'this' Args? / 'super' ( Args / &( '.' / '::' ) ) / 'new' Creator / Switch / '(' Expr ')' / Type '::' TypeArgs? ( Id / 'new' ) / ( PRIMITIVE / 'void' ) Dims '.' 'class' / ClassType ( '[' ']' )+ '.' 'class' / Id Args / Id
Creator <- Annotation* TypeArgs? ( PRIMITIVE / ClassType ) ( ( '[' ']' )+ {ArrayInit} / ( '[' Expr ']' )+ Dims / Args {ClassBody}? )
Args <- '(' Exprs? ')'
Id <- NAME
"""

GO = r"""
File <- 'package' NAME ';' ( Import ';' )* ( TopDecl ';' )* END
Import <- 'import' ( ImportSpec / '(' ( ImportSpec ';' )* ImportSpec? ')' )
ImportSpec <- ( '.' / NAME )? STR
TopDecl <- FuncDecl / Decl
Decl <- 'const' ( ConstSpec / '(' ( ConstSpec ';' )* ConstSpec? ')' ) / 'var' ( VarSpec / '(' ( VarSpec ';' )* VarSpec? ')' ) / 'type' ( TypeSpec / '(' ( TypeSpec ';' )* TypeSpec? ')' )
ConstSpec <- Names ( Type? '=' Exprs )?
VarSpec <- Names ( '=' Exprs / Type ( '=' Exprs )? )
TypeSpec <- NAME ( TypeParams &( '=' / Type ) )? '='? Type
Names <- NAME ( ',' NAME )*
TypeParams <- '[' TypeParam ( ',' TypeParam )* ','? ']'
TypeParam <- Names Constraint
Constraint <- '~'? Type ( '|' '~'? Type )*
FuncDecl <- 'func' ( '(' Params? ')' )? NAME TypeParams? FuncSig {Block}?
FuncSig <- '(' Params? ')' Result?
Result <- '(' Params? ')' / Type
Params <- Param ( ',' Param )* ','?
Param <- NAME '...'? Type / '...'? Type
Type <- '*' Type / '[' ']' Type / '[' ( '...' / Expr ) ']' Type / 'map' '[' Type ']' Type / '<-' 'chan' Type / 'chan' '<-'? Type / 'func' FuncSig / 'struct' {StructBody} / 'interface' {InterfaceBody} / '(' Type ')' / NAME ( '.' NAME )? ( '[' Type ( ',' Type )* ','? ']' )?
StructBody <- ( StructField ';' )* StructField? END
StructField <- ( Names Type / '*'? NAME ( '.' NAME )? ( '[' Type ( ',' Type )* ']' )? ) STR?
InterfaceBody <- ( InterfaceItem ';' )* InterfaceItem? END
InterfaceItem <- NAME FuncSig / Constraint
StmtList <- ( Stmt? ';' )* Stmt? END
Stmt <- Decl / {Block} / If / For / Switch / Select / 'return' Exprs? / 'break' NAME? / 'continue' NAME? / 'goto' NAME / 'fallthrough' / 'go' Expr / 'defer' Expr / NAME ':' Stmt? / Simple
Simple <- Names ':=' Exprs / Exprs ( ( '=' / OPASSIGN ) Exprs / '++' / '--' / '<-' Expr )?
If <- 'if' ( Simple? ';' )? Simple {Block} ( 'else' ( If / {Block} ) )?
For <- 'for' ( {Block} / ( Exprs ( ':=' / '=' ) )? 'range' Expr {Block} / Simple? ';' Expr? ';' Simple? {Block} / Simple {Block} )
Switch <- 'switch' ( Simple? ';' )? ( ( NAME ':=' )? Expr '.' '(' 'type' ')' / Simple )? {SwitchBody}
SwitchBody <- ( ( 'case' ( CaseItem ( ',' CaseItem )* ) / 'default' ) ':' ( Stmt? ';' )* ( Stmt &( 'case' / 'default' / END ) )? )* END
CaseItem <- Expr / Type
Select <- 'select' {SelectBody}
SelectBody <- ( ( 'case' ( Exprs ( ':=' / '=' ) Expr / Simple ) / 'default' ) ':' ( Stmt? ';' )* ( Stmt &( 'case' / 'default' / END ) )? )* END
Exprs <- Expr ( ',' Expr )*
Expr <- Unary ( ( BINOP / '*' / '&' / '|' / '<-' &NEVER ) Unary )*
Unary <- ( UNARYOP / '*' / '&' / '<-' ) Unary / Primary
Primary <- Operand Suffix*
Suffix <- '.' ( NAME / '(' ( 'type' / Type ) ')' ) / '[' ( Expr? ':' Expr? ( ':' Expr )? / ( Type / Expr ) ( ',' ( Type / Expr ) )* ','? ) ']' / Args / {Literal}
Args <- '(' ( Arg ( ',' Arg )* '...'? ','? )? ')'
Arg <- Expr / Type
Operand <- LITERAL / 'func' FuncSig {Block} / LitType {Literal} / LitType &'(' / NAME / '(' ( Expr / Type ) ')'
LitType <- '[' ']' Type / '[' ( '...' / Expr ) ']' Type / 'map' '[' Type ']' Type / 'struct' {StructBody} / 'chan' Type / 'interface' {InterfaceBody}
Literal <- ( Element ( ',' Element )* ','? )? END
Element <- ( ( Expr / {Literal} ) ':' )? ( Expr / {Literal} )
"""

#: A logical line of Python. Block headers end with ':' and may hold simple statements after it.
PYTHON = r"""
Line <- ( Header / Simple ) END
Header <- ( 'async'? ( Def / For / With ) / Class / If / Elif / Else / While / Try / Except / Finally / Match / Case ) ':' Simple?
Open <- ( 'async'? ( Def / For / With ) / Class / If / Elif / Else / While / Try / Except / Finally / Match / Case ) ':' END
Simple <- Small ( ';' Small )* ';'?
Decorator <- '@' Named END
Def <- 'def' Id TypeParams? '(' Params? ')' ( '->' Test )?
Class <- 'class' Id TypeParams? ( '(' Args? ')' )?
TypeParams <- '[' TypeParam ( ',' TypeParam )* ','? ']'
TypeParam <- ( '*' / '**' )? Id ( ':' Test )? ( '=' StarTest )?
Params <- ( Leading ( ',' Starred )? / Starred ) ','?
Leading <- Plains ',' '/' ( ',' Plain )* ( ',' Preset )* / Plains ( ',' Preset )+ ',' '/' ( ',' Preset )* / Presets ( ',' '/' ( ',' Preset )* )? / Plains ( ',' Preset )*
Plains <- Plain ( ',' Plain )*
Plain <- Id ( ':' Test )? !'='
Presets <- Preset ( ',' Preset )*
Preset <- Id ( ':' Test )? '=' Test
Starred <- ( '*' Id ( ':' StarTest )? ( ',' KeyOnly )* / '*' ( ',' KeyOnly )+ ) ( ',' Keywords )? / Keywords
KeyOnly <- Id ( ':' Test )? ( '=' Test )?
Keywords <- '**' Id ( ':' Test )?
For <- 'for' Targets 'in' StarTests
With <- 'with' ( '(' WithItem ( ',' WithItem )* ','? ')' &':' / WithItem ( ',' WithItem )* )
WithItem <- Test ( 'as' Target )?
If <- 'if' Named
Elif <- 'elif' Named
Else <- 'else'
While <- 'while' Named
Try <- 'try'
Except <- 'except' '*'? ( Test ( ',' Test )* ( 'as' Id )? )?
Finally <- 'finally'
Match <- 'match' StarNamed
Case <- 'case' Patterns ( 'if' Named )?
Patterns <- PatternItem ( ',' PatternItem )* ','?
PatternItem <- '*' Id / Pattern
Pattern <- OrPattern ( 'as' Id )?
OrPattern <- PatternAtom ( '|' PatternAtom )*
PatternAtom <- '-'? NUM ( ( '+' / '-' ) NUM )? / STR+ / 'None' / 'True' / 'False' / '(' Patterns? ')' / '[' Patterns? ']' / '{' ( MapItem ( ',' MapItem )* ','? )? '}' / Id ( '.' Id )* ( '(' ( PatternArg ( ',' PatternArg )* ','? )? ')' )?
MapItem <- '**' Id / ( PatternAtom ) ':' Pattern
PatternArg <- Id '=' Pattern / Pattern
Small <- 'pass' / 'break' / 'continue' / Return / Raise / Global / Del / Assert / Import / TypeAlias / Assignment / StarTests
Return <- 'return' StarTests?
Raise <- 'raise' ( Test ( 'from' Test )? )?
Global <- ( 'global' / 'nonlocal' ) Id ( ',' Id )*
Del <- 'del' Targets
Assert <- 'assert' Test ( ',' Test )?
Import <- 'import' Dotted ( ',' Dotted )* / 'from' ( ( '.' / '...' )* DottedName / ( '.' / '...' )+ ) 'import' ( '*' / '(' ImportAs ( ',' ImportAs )* ','? ')' / ImportAs ( ',' ImportAs )* )
Dotted <- DottedName ( 'as' Id )?
DottedName <- Id ( '.' Id )*
ImportAs <- Id ( 'as' Id )?
TypeAlias <- 'type' Id TypeParams? '=' Test
Assignment <- OneTarget ':' Test ( '=' ( Yield / StarTests ) )? / ( Targets '=' !'=' )+ ( Yield / StarTests ) / OneTarget AUGASSIGN ( Yield / StarTests )
OneTarget <- Atom Trailer* TargetEnd / Id !TrailStart / '(' OneTarget ')' !TrailStart
Targets <- StarTarget ( ',' StarTarget )* ','?
StarTarget <- '*'? Target
Target <- '(' Targets? ')' !TrailStart / '[' Targets? ']' !TrailStart / Atom Trailer* TargetEnd / Id !TrailStart
TrailStart <- '(' / '[' / '.'
Trailer <- ( '.' Id / '[' Slices ']' / '(' Args? ')' ) &TrailStart
TargetEnd <- '.' Id / '[' Slices ']'
Yield <- 'yield' ( 'from' Test / StarTests )?
StarTests <- Yield / StarTest ( ',' StarTest )* ','?
StarTest <- '*' Binary / Named
StarNamed <- StarTest ( ',' StarTest )* ','?
Named <- Id ':=' Test / Test
Test <- Lambda / Or ( 'if' Or 'else' Test )?
Lambda <- 'lambda' LambdaParams? ':' Test
LambdaParams <- ( LLeading ( ',' LStarred )? / LStarred ) ','?
LLeading <- LPlains ',' '/' ( ',' LPlain )* ( ',' LPreset )* / LPlains ( ',' LPreset )+ ',' '/' ( ',' LPreset )* / LPresets ( ',' '/' ( ',' LPreset )* )? / LPlains ( ',' LPreset )*
LPlains <- LPlain ( ',' LPlain )*
LPlain <- Id !'='
LPresets <- LPreset ( ',' LPreset )*
LPreset <- Id '=' Test
LStarred <- ( '*' Id ( ',' LKeyOnly )* / '*' ( ',' LKeyOnly )+ ) ( ',' '**' Id )? / '**' Id
LKeyOnly <- Id ( '=' Test )?
Or <- And ( 'or' And )*
And <- Not ( 'and' Not )*
Not <- 'not' Not / Compare
Compare <- Binary ( ( COMPARE / 'not' 'in' / 'in' / 'is' 'not'? ) Binary )*
Binary <- Unary ( BINOP Unary )*
Unary <- ( '+' / '-' / '~' ) Unary / Power
Power <- 'await'? Primary ( '**' Unary )?
Primary <- Atom ( '.' Id / '[' Slices ']' / '(' Args? ')' )*
Slices <- Slice ( ',' Slice )* ','?
Slice <- '*' Binary / Named? ':' Test? ( ':' Test? )? / Named
Args <- Named Comp !',' / ( Places ( ',' Named1 )? / Named1 ) ','?
Places <- Place ( ',' Place )*
Place <- '*' Test / Named !'=' !'for'
Named1 <- ( ByName ( ',' ( ByName / '*' Test ) )* ( ',' Mapped )? / Mapped )
ByName <- Id '=' !'=' Test
Mapped <- '**' Test ( ',' ( '**' Test / ByName ) )*
Atom <- '(' ( Yield / StarTest ( Comp / ( ',' StarTest )* ','? ) )? ')' / '[' ( StarTest ( Comp / ( ',' StarTest )* ','? ) )? ']' / '{' ( DictItem ( Comp / ( ',' DictItem )* ','? ) / StarTest ( Comp / ( ',' StarTest )* ','? ) )? '}' / STR+ / NUM / '...' / 'None' / 'True' / 'False' / Id
DictItem <- '**' Binary / Test ':' Test
Comp <- ( 'async'? 'for' Targets 'in' Or ( 'if' CompIf )* )+
CompIf <- Id ':=' Test / Lambda / Or
Id <- NAME
Field <- ( Yield / StarTests ) END
"""
