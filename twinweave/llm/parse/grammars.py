"""Grammars of the languages that are checked.

They describe what is syntactically valid, a little loosely: operators have no
precedence, and what only a compiler's later stages reject is accepted. See
tables.Grammar for the notation.
"""

from __future__ import annotations

JSON = """
json: value ;
value: object | array | STR | NUM | 'true' | 'false' | 'null' ;
object: '{' (pair // ',')? '}' ;
pair: STR ':' value ;
array: '[' (value // ',')? ']' ;
"""

# style sheets: {} stands for what the dialects add
CSS = """
sheet: item* ;
item: rule | at ';' | at block | ';' | CDO | CDC DIALECT ;
rule: selector block ;
selector: (sel // ',') ','? ;
sel: part+ ;
part: ID | HASH | '.' ID | '.' DIM | '*' | '>' | '+' | '~' | '&' | '&' ID | '&' DIM | ':' | '|' | '%' ID | PCT | '[' any* ']' | '(' any* ')' | VAR STR_OPT ;
at: AT prelude* ;
prelude: ID | NUM | DIM | PCT | STR | HASH | URL | VAR | AT | '.' | ',' | ':' | '>' | '<' | '=' | '*' | '/' | '+' | '-' | '~' | '&' | '!' | '|' | '(' any* ')' | '[' any* ']' ;
block: '{' body? '}' ;
body: bodyitem* last? ;
bodyitem: decl ';' | ';' | nested | at ';' | at block | BODY ;
last: decl | at LAST ;
nested: selector block ;
decl: name ':' value ;
name: ID | VAR | '*' ID | NAME ;
value: vpart+ ;
vpart: ID | NUM | DIM | PCT | STR | HASH | URL | VAR | AT | ',' | '/' | '+' | '-' | '*' | '!' | '=' | '.' | ':' | '>' | '<' | '~' | '%' | '&' | '|' | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
any: ID | NUM | DIM | PCT | STR | HASH | URL | VAR | AT | ',' | '/' | '+' | '-' | '*' | '!' | '=' | '.' | ':' | ';' | '>' | '<' | '~' | '%' | '&' | '|' | '^' | '$' | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
"""


def css(dialect: str) -> str:
    top, body, last, name = "", "';'", "ID '(' any* ')'", "AT '-'"
    if dialect == "scss":
        top, body = "| VAR ':' value ';' | VAR ':' any* ';'", "name ':' block | name ':' value block"
    elif dialect == "less":
        call = "mixin ';'"
        top = f"| AT ':' value ';' | AT ':' block ';'? | {call} | AT '(' any* ')' ';' | selector 'when' prelude+ block"
        body = f"AT ':' value ';' | AT ':' block ';'? | {call} | AT '(' any* ')' ';' | selector 'when' prelude+ block | selector ';'"
        last = "mixin | AT ':' value"
    text = CSS.replace("DIALECT", top).replace("BODY", body).replace("LAST", "| " + last).replace("| NAME", "").replace(" STR_OPT", "")
    if dialect == "less":
        text += "mixin: selector '!' ID | selector ;\n"
    return text


C_EXPR = """
expr: assign // ',' ;
assign: operand (op operand)* | operand (op operand)* '?' expr? ':' assign ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' OPS ;
operand: prefix* post ;
prefix: '+' | '-' | '!' | '~' | '*' | '&' | '++' | '--' | 'sizeof' | '(' typename ')' PREFIX ;
post: prim | post '[' expr? ']' | post '(' args? ')' | post '.' ID | post '->' ID | post '++' | post '--' POST ;
"""

C = (
    """
unit: ext* ;
ext: func | decl | ';' | 'asm' '(' STR ')' ';' ;
func: specs declr block | declr block ;
decl: specs (init // ',')? ';' | sassert ;
sassert: '_Static_assert' '(' assign (',' STR)? ')' ';' ;
specs: q* type q* | q* ID type q* ;
q: 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'register' | 'restrict' | 'typedef' | '_Noreturn' | '_Thread_local' | '_Atomic' | attr | 'auto' ;
attr: '__attribute__' '(' any* ')' ;
any: ANY | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
type: base+ | ID | 'struct' attr? ID | 'struct' attr? ID? sbody | 'union' ID? sbody | 'union' ID | 'enum' ID | 'enum' ID? '{' (enumor // ',') ','? '}' | 'typeof' '(' any* ')' | base q base ;
base: 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | '_Bool' | '_Complex' ;
sbody: '{' field* '}' attr? ;
field: specs (fdeclr // ',')? ';' | ';' | sassert ;
fdeclr: declr (':' assign)? | ':' assign ;
enumor: ID ('=' assign)? ;
init: declr attr* ('=' initval)? ;
initval: assign | braces ;
braces: '{' ((initem // ',') ','?)? '}' ;
initem: designator* initval ;
designator: '.' ID '='? | '[' expr ']' '='? ;
declr: ptr* ddeclr ;
ptr: '*' pq* ;
pq: 'const' | 'volatile' | 'restrict' | '_Atomic' ;
ddeclr: ID | '(' declr ')' | ddeclr '[' pq* 'static'? assign? ']' | ddeclr '(' params? ')' ;
params: param // ',' | (param // ',') ',' '...' ;
param: specs declr? | specs adeclr ;
adeclr: ptr+ | ptr* adirect ;
adirect: '(' adeclr ')' | '[' assign? ']' | adirect '[' assign? ']' | adirect '(' params? ')' | '(' params? ')' ;
typename: specs adeclr? ;
block: '{' bitem* '}' ;
bitem: decl | stmt ;
stmt: block | expr? ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forinit expr? ';' expr? ')' stmt
  | 'switch' '(' expr ')' stmt | 'case' assign ('...' assign)? ':' bitem? | 'default' ':' bitem? | ID ':' bitem? | 'break' ';' | 'continue' ';' | 'return' expr? ';' | 'goto' ID ';' | 'asm' q? '(' any* ')' ';' ;
forinit: expr? ';' | decl ;
prim: ID | NUM | STRS | CHR | '(' expr ')' | '(' typename ')' braces | '(' block ')' | 'sizeof' '(' typename ')' | '_Generic' '(' any* ')' ;
STRS_: STR+ ;
args: arg // ',' ;
arg: assign | typename ;
"""
    + C_EXPR.replace("OPS", "").replace("PREFIX", "").replace("POST", "")
).replace("STRS_: STR+ ;", "strs: STR+ ;").replace("STRS", "strs")

CPP = (
    """
unit: ext* ;
ext: func | decl | ';' | template | 'namespace' (qid)? attr* '{' ext* '}' | 'inline' 'namespace' ID '{' ext* '}' | 'extern' STR '{' ext* '}' | 'extern' STR ext | using | 'asm' '(' any* ')' ';' ;
using: 'using' 'namespace' qid ';' | 'using' 'typename'? qid ';' | 'using' ID attr* '=' typename ';' | 'namespace' ID '=' qid ';' | 'using' 'enum' qid ';' ;
template: 'template' '<' (tparam // ',')? '>' requires? ext | 'template' '<' (tparam // ',')? '>' requires? 'concept' ID '=' expr ';' | 'template' ext ;
requires: 'requires' expr ;
tparam: ('class' | 'typename') '...'? ID? ('=' typename)? | 'template' '<' (tparam // ',')? '>' ('class' | 'typename') '...'? ID? | param ;
func: specs? declr tail* body | specs? declr tail* ctor body | specs? declr tail* '=' ('default' | 'delete') ';' ;
tail: 'const' | 'noexcept' | 'noexcept' '(' expr ')' | 'override' | 'final' | '&' | '&&' | '->' typename | 'volatile' | requires | attr | 'throw' '(' any* ')' ;
ctor: ':' (minit // ',') ;
minit: qid ('(' args? ')' | braces) '...'? ;
body: block | 'try' block handler+ ;
decl: specs (init // ',')? ';' | declr tail* ';' | 'static_assert' '(' args ')' ';' | specs attr* '[' (ID // ',') ']' '=' initval ';' | specs '&' '[' (ID // ',') ']' '=' initval ';' ;
specs: q* type q* | q* ID type q* | q+ ;
q: 'static' | 'extern' | 'inline' | 'const' | 'volatile' | 'register' | 'typedef' | 'constexpr' | 'consteval' | 'constinit' | 'mutable' | 'virtual' | 'explicit' | 'friend' | 'thread_local' | attr ;
attr: '__attribute__' '(' any* ')' | '[' '[' any* ']' ']' | 'alignas' '(' any* ')' ;
any: ANY | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
type: base+ | qid | 'typename' qid | 'auto' | 'decltype' '(' expr ')' | key attr* qid | key attr* (qid 'final'?)? bases? cbody | 'enum' ('class' | 'struct')? qid (':' typename)? | 'enum' ('class' | 'struct')? qid? (':' typename)? '{' ((enumor // ',') ','?)? '}' | base q base ;
key: 'class' | 'struct' | 'union' ;
base: 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'signed' | 'unsigned' | 'bool' | 'wchar_t' ;
bases: ':' (baseitem // ',') ;
baseitem: ('virtual' | 'public' | 'private' | 'protected')* qid '...'? ;
cbody: '{' member* '}' ;
member: ('public' | 'private' | 'protected') ':' | func | field | ';' | template | using ;
field: specs (fdeclr // ',')? ';' | declr tail* ';' | 'static_assert' '(' args ')' ';' ;
fdeclr: declr tail* (':' assign)? ('=' initval)? | declr braces | ':' assign | declr tail* '=' NUM ;
enumor: ID attr? ('=' assign)? ;
init: declr attr* tail* ('=' initval)? | declr braces | declr '(' args ')' ;
initval: assign | braces ;
braces: '{' ((initem // ',') ','?)? '}' ;
initem: designator* initval '...'? ;
designator: '.' ID '='? | '[' expr ']' '=' ;
qid: '::'? (seg // '::') ;
seg: name targs? | '~' ID | 'operator' opname | 'template' ID targs ;
name: ID | 'final' | 'override' ;
targs: '<' (targ // ',')? '>' ;
targ: typename '...'? | assign | braces ;
opname: op | '(' ')' | '[' ']' | '++' | '--' | '!' | '~' | '->' | ',' | 'new' | 'delete' | ('new' | 'delete') '[' ']' | typename | STR ID ;
declr: ptr* ddeclr ;
ptr: '*' pq* | '&' | '&&' | qid '::' '*' | '...' ;
pq: 'const' | 'volatile' ;
ddeclr: qid | '(' declr ')' | ddeclr '[' assign? ']' | ddeclr '(' params? ')' ;
params: param // ',' | (param // ',') ',' '...' | '...' ;
param: attr* specs declr? ('=' initval)? | specs adeclr ('=' initval)? ;
adeclr: ptr+ | ptr* adirect ;
adirect: '(' adeclr ')' | '[' assign? ']' | adirect '[' assign? ']' | adirect '(' params? ')' | '(' params? ')' ;
typename: specs adeclr? tail* ;
block: '{' bitem* '}' ;
bitem: decl | stmt | using | template ;
stmt: block | expr? ';' | attr stmt | 'if' 'constexpr'? '(' cond ')' stmt | 'if' 'constexpr'? '(' cond ')' stmt 'else' stmt | 'while' '(' cond ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forinit cond? ';' expr? ')' stmt
  | 'for' '(' specs declr ':' initval ')' stmt | 'for' '(' specs ptr* '[' (ID // ',') ']' ':' initval ')' stmt | 'switch' '(' cond ')' stmt | 'case' assign ('...' assign)? ':' bitem? | 'default' ':' bitem? | ID ':' bitem? | 'break' ';' | 'continue' ';' | 'return' initval? ';' | 'co_return' expr? ';' | 'goto' ID ';'
  | 'try' block handler+ | 'asm' q? '(' any* ')' ';' ;
handler: 'catch' '(' (param | '...') ')' block ;
cond: expr | specs declr ('=' initval | braces) | forinit expr ;
forinit: expr? ';' | decl ;
prim: qid | NUM | strs | CHR | 'true' | 'false' | 'nullptr' | 'this' | '(' expr ')' | '(' typename ')' braces | qid braces | base '(' args? ')' | base braces | cast '<' typename '>' '(' expr ')' | 'sizeof' '(' typename ')' | 'sizeof' '...' '(' ID ')' | 'alignof' '(' typename ')' | 'typeid' '(' typename ')' | 'typeid' '(' expr ')' | 'noexcept' '(' expr ')' | lambda | new | fold | 'requires' any_req | 'typename' qid '(' args? ')' | 'typename' qid braces ;
any_req: ('(' params? ')')? '{' any* '}' ;
fold: '(' operand op '...' ')' | '(' '...' op operand ')' | '(' operand op '...' op operand ')' ;
cast: 'static_cast' | 'dynamic_cast' | 'reinterpret_cast' | 'const_cast' ;
lambda: '[' any* ']' targs? ('(' params? ')')? ('mutable' | 'constexpr' | 'noexcept' | '->' typename)* block ;
new: '::'? 'new' ('(' args ')')? specs ptr* ('[' expr ']')* ('(' args? ')' | braces)? | '::'? 'new' ('(' args ')')? '(' typename ')' ;
strs: STR+ ;
args: arg // ',' ;
arg: initval '...'? | typename ;
"""
    + C_EXPR.replace("OPS", "| '<=>' | '.*' | '->*' | 'and' | 'or'").replace("PREFIX", "| 'not' | 'delete' | 'delete' '[' ']' | 'throw' | 'co_await' | 'co_yield'").replace("POST", "| post '.' seg | post '->' seg | post '.' '~' ID")
).replace("any: ANY", "any: ANY")

GO = """
file: 'package' ID ';' import* top* ;
import: 'import' (spec | '(' (spec ';')* spec? ')') ';' ;
spec: (ID | '.')? STR ;
top: decl ';' | func ';' | ';' ;
decl: 'var' (vspec | '(' (vspec ';')* vspec? ')') | 'const' (vspec | '(' (vspec ';')* vspec? ')') | 'type' (tspec | '(' (tspec ';')* tspec? ')') ;
vspec: ids type? ('=' exprs)? ;
tspec: ID ('[' tparam // ',' ']')? '='? type ;
tparam: ids type ;
ids: ID // ',' ;
func: 'func' params? ID ('[' (tparam // ',') ','? ']')? sig block? ;
sig: params result? ;
result: type | params ;
params: '(' ((param // ',') ','?)? ')' ;
param: type | ID type | '...' type | ID '...' type ;
type: tname | '*' type | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | chan | 'func' sig | 'struct' '{' (field ';')* field? '}' | 'interface' '{' (imeth ';')* imeth? '}' | '(' type ')' | '~' type | type '|' type ;
tname: ID | ID '.' ID | tname '[' (type // ',') ']' ;
chan: 'chan' type | '<-' 'chan' type | 'chan' '<-' type ;
field: ids type STR? | '*'? tname STR? ;
imeth: ID sig | type ;
block: '{' stmts '}' ;
stmts: (stmt? ';')* stmt? ;
stmt: simple | decl | 'return' exprs? | 'break' ID? | 'continue' ID? | 'goto' ID | 'fallthrough' | 'go' expr | 'defer' expr | block | if | for | switch | select | ID ':' stmt? ;
simple: expr | exprs asg exprs | expr ('++' | '--') | expr '<-' expr ;
asg: '=' | ':=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
if: 'if' (simple? ';')? expr block ('else' (if | block))? ;
for: 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' (exprs ('=' | ':='))? 'range' expr block ;
switch: 'switch' (simple? ';')? simple? '{' clause* '}' | 'switch' (simple ';')? (ID ':=')? post '.' '(' 'type' ')' '{' clause* '}' ;
clause: ('case' (texpr // ',') | 'default') ':' stmts ;
texpr: expr | type ;
select: 'select' '{' (('case' simple | 'default') ':' stmts)* '}' ;
exprs: expr // ',' ;
expr: unary (op unary)* ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>>' | '&^' ;
unary: pre* post ;
pre: '+' | '-' | '!' | '^' | '*' | '&' | '<-' ;
post: prim | post '.' ID | post '.' '(' type ')' | post '[' expr ']' | post '[' (type // ',') ','? ']' | post '[' expr? ':' expr? ']' | post '[' expr? ':' expr ':' expr ']' | post '(' ((arg // ',') '...'? ','?)? ')' | lit ;
arg: expr | type ;
prim: ID | NUM | STR | CHR | '(' expr ')' | '(' type ')' | 'func' sig block ;
lit: ltype '{' elems? '}' ;
ltype: tname | '[' ']' type | '[' expr ']' type | '[' '...' ']' type | 'map' '[' type ']' type | 'struct' '{' (field ';')* field? '}' ;
elems: (elem // ',') ','? ;
elem: (val ':')? val ;
val: expr | '{' elems? '}' ;
"""

JAVA = """
unit: (annot* 'package' qname ';')? import* typedecl* ;
import: 'import' 'static'? qname ('.' '*')? ';' | ';' ;
qname: ID // '.' ;
typedecl: mod* kind | ';' ;
kind: class | enum | iface | record | annodecl ;
mod: 'public' | 'private' | 'protected' | 'static' | 'final' | 'abstract' | 'native' | 'synchronized' | 'transient' | 'volatile' | 'strictfp' | 'default' | annot | 'sealed' | 'non' '-' 'sealed' ;
annot: '@' qname ('(' any* ')')? ;
any: ANY | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
class: 'class' ID tparams? ('extends' type)? ('implements' types)? ('permits' types)? cbody ;
record: 'record' ID tparams? '(' params? ')' ('implements' types)? cbody ;
iface: 'interface' ID tparams? ('extends' types)? ('permits' types)? cbody ;
annodecl: '@' 'interface' ID cbody ;
enum: 'enum' ID ('implements' types)? '{' ((enumc // ',') ','?)? (';' member*)? '}' ;
enumc: annot* ID ('(' args? ')')? cbody? ;
tparams: '<' (tparam // ',') '>' ;
tparam: annot* ID ('extends' (type // '&'))? ;
types: type // ',' ;
cbody: '{' member* '}' ;
member: mod* (field | method | ctor | kind) | ';' | 'static'? block ;
field: type (vdecl // ',') ';' ;
vdecl: ID dims? ('=' vinit)? ;
vinit: expr | '{' ((vinit // ',') ','?)? '}' ;
method: tparams? type ID '(' params? ')' dims? throws? (block | ';') | tparams? type ID '(' params? ')' 'default' any* ';' ;
ctor: tparams? ID '(' params? ')' throws? block | ID block ;
throws: 'throws' types ;
params: param // ',' ;
param: mod* type '...'? ID dims? | mod* type 'this' ;
type: annot* btype dims? ;
dims: ('[' ']')+ ;
btype: prim | seg // '.' ;
seg: annot* ID targs? ;
prim: 'int' | 'char' | 'short' | 'long' | 'float' | 'double' | 'void' | 'boolean' | 'byte' ;
targs: '<' (targ // ',')? '>' ;
targ: type | annot* '?' (('extends' | 'super') type)? ;
block: '{' bstmt* '}' ;
bstmt: mod* type (vdecl // ',') ';' | mod* kind | stmt ;
stmt: block | ';' | expr ';' | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' forinit? ';' expr? ';' exprs? ')' stmt | 'for' '(' mod* type ID ':' expr ')' stmt
  | 'return' expr? ';' | 'break' ID? ';' | 'continue' ID? ';' | 'throw' expr ';' | 'synchronized' '(' expr ')' block | ID ':' stmt | 'assert' expr (':' expr)? ';' | 'yield' expr ';' | try | switch ;
forinit: mod* type (vdecl // ',') | exprs ;
exprs: expr // ',' ;
try: 'try' ('(' (res // ';') ';'? ')')? block catch* ('finally' block)? ;
res: mod* type ID '=' expr | expr ;
catch: 'catch' '(' mod* (type // '|') ID ')' block ;
switch: 'switch' '(' expr ')' '{' (label bstmt* | arrow)* '}' ;
label: ('case' (clabel // ',') | 'default') ':' ;
arrow: ('case' (clabel // ',') ('when' expr)? | 'default') '->' (expr ';' | block | 'throw' expr ';') ;
clabel: expr | type ID | 'default' | 'null' ;
expr: unary (op unary)* ('instanceof' mod* type ID?)? tail? ;
tail: '?' expr ':' expr | (op) lambda | '&&' expr | '||' expr | '==' expr ;
lambda: (ID | '(' ')' | '(' (ID // ',') ')' | '(' params ')') '->' (expr | block) ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' ;
unary: pre* post | lambda ;
pre: '+' | '-' | '!' | '~' | '++' | '--' | '(' type ('&' type)* ')' ;
post: primary | post '.' ID | post '.' targs ID | post '.' 'new' new | post '.' 'class' | post '.' 'this' | post '.' 'super' | post '[' expr ']' | post '(' args? ')' | post '++' | post '--' | post '::' (ID | 'new') ;
primary: ID | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'super' | '(' expr ')' | 'new' new | type '::' (ID | 'new') | prim dims? '.' 'class' | seg dims '.' 'class' | switch | 'void' '.' 'class' ;
new: annot* btype ('(' args? ')' cbody? | ('[' expr ']')+ dims? | dims '{' ((vinit // ',') ','?)? '}') ;
args: expr // ',' ;
"""

CSHARP = """
unit: top* ;
top: using | ns | gattr | typedecl | stmt | ';' | mod* ret id tparams? '(' params? ')' where* (block | '=>' expr ';') ;
using: 'global'? 'using' 'static'? (id '=')? type ';' ;
ns: 'namespace' qname ('{' top* '}' ';'? | ';') ;
gattr: attr ;
attr: '[' any* ']' ;
any: ANY | '(' any* ')' | '[' any* ']' | '{' any* '}' ;
qname: id // ('.' | '::') ;
id: ID | 'var' | 'get' | 'set' | 'add' | 'remove' | 'where' | 'async' | 'await' | 'partial' | 'yield' | 'record' | 'when' | 'value' | 'init' | 'dynamic' | 'nameof' | 'from' | 'select' | 'global' | 'not' | 'and' | 'or' | 'with' | 'required' | 'file' ;
typedecl: mod* kind ;
mod: 'public' | 'private' | 'protected' | 'internal' | 'static' | 'readonly' | 'sealed' | 'abstract' | 'virtual' | 'override' | 'extern' | 'unsafe' | 'new' | 'partial' | 'const' | 'volatile' | 'async' | 'fixed' | 'required' | 'file' | 'ref' | attr ;
kind: ('class' | 'struct' | 'interface' | 'record' | 'record' 'struct' | 'record' 'class') id tparams? ('(' params? ')')? bases? where* (cbody ';'? | ';') | 'enum' id (':' type)? '{' ((attr* id ('=' expr)?) // ',' ','?)? '}' ';'? | 'delegate' ret id tparams? '(' params? ')' where* ';' ;
bases: ':' ((type ('(' args? ')')?) // ',') ;
where: 'where' id ':' ((type | 'class' '?'? | 'struct' | 'new' '(' ')' | 'notnull' | 'unmanaged' | 'default') // ',') ;
tparams: '<' ((attr* ('in' | 'out')? id) // ',') '>' ;
cbody: '{' member* '}' ;
member: mod* (field | method | prop | indexer | event | ctor | oper | kind | '~' id '(' ')' body) ;
field: type (vdecl // ',') ';' ;
vdecl: id ('[' expr ']')? ('=' vinit)? ;
vinit: expr | arrinit | 'ref' expr | 'stackalloc' type ;
arrinit: '{' ((vinit // ',') ','?)? '}' ;
ret: 'ref'? 'readonly'? type ;
mname: (id targs? '.')* id ;
method: ret mname tparams? '(' params? ')' where* body ;
body: block | '=>' expr ';' | ';' ;
prop: ret mname '{' accessor+ '}' ('=' vinit ';')? | ret mname '=>' expr ';' ;
indexer: ret (mname '.')? 'this' '[' params ']' ('{' accessor+ '}' | '=>' expr ';') ;
accessor: mod* ('get' | 'set' | 'init' | 'add' | 'remove') body ;
event: 'event' type (vdecl // ',') ';' | 'event' type mname '{' accessor+ '}' ;
ctor: id '(' params? ')' (':' ('base' | 'this') '(' args? ')')? body ;
oper: type 'operator' 'checked'? opname '(' params ')' body | ('implicit' | 'explicit') 'operator' type '(' params ')' body ;
opname: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '<<' | '>' '>' | '!' | '~' | '++' | '--' | 'true' | 'false' ;
params: param // ',' ;
param: attr* ('ref' | 'out' | 'in' | 'params' | 'this' | 'scoped' | 'readonly')* type id ('=' expr)? ;
type: btype ('?' | '[' ','* ']' | '*')* ;
btype: prim | tseg // ('.' | '::') | '(' tupel ',' (tupel // ',') ')' | 'delegate' '*' any* ;
tupel: type id? ;
tseg: id targs? ;
targs: '<' (type // ',') '>' | '<' ','* '>' ;
prim: 'int' | 'uint' | 'long' | 'ulong' | 'short' | 'ushort' | 'byte' | 'sbyte' | 'char' | 'float' | 'double' | 'decimal' | 'bool' | 'string' | 'object' | 'void' ;
block: '{' stmt* '}' ;
local: ('const' | 'ref' | 'using' | 'await' | 'scoped' | 'readonly')* type (vdecl // ',') ;
stmt: block | ';' | expr ';' | local ';' | attr* ('static' | 'async' | 'unsafe' | 'extern')* ret id tparams? '(' params? ')' where* body | 'if' '(' expr ')' stmt | 'if' '(' expr ')' stmt 'else' stmt | 'while' '(' expr ')' stmt | 'do' stmt 'while' '(' expr ')' ';' | 'for' '(' (local | exprs)? ';' expr? ';' exprs? ')' stmt
  | 'await'? 'foreach' '(' (type id | desig) 'in' expr ')' stmt | 'return' 'ref'? expr? ';' | 'break' ';' | 'continue' ';' | 'throw' expr? ';' | 'goto' (id | 'case' expr | 'default') ';' | 'lock' '(' expr ')' stmt | 'await'? 'using' '(' (local | expr) ')' stmt | 'fixed' '(' local ')' stmt
  | ('checked' | 'unchecked' | 'unsafe') block | 'yield' ('return' expr | 'break') ';' | id ':' stmt | try | 'switch' '(' expr ')' '{' (label+ stmt+)* '}' ;
desig: ('var' | type) '(' ((type? id) // ',') ')' | '(' ((type? id) // ',') ')' ;
label: 'case' pattern ('when' expr)? ':' | 'default' ':' ;
try: 'try' block catch* ('finally' block)? ;
catch: 'catch' ('(' type id? ')')? ('when' '(' expr ')')? block ;
exprs: expr // ',' ;
expr: item (op item)* | item (op item)* '?' expr ':' expr | lambda | 'throw' expr | query | desig '=' expr ;
item: unary | unary ('is' | 'as') pattern | unary 'switch' '{' ((pattern ('when' expr)? '=>' expr) // ',' ','?)? '}' | unary 'with' arrinit | unary '..' unary? | '..' unary? ;
pattern: pat (('and' | 'or') pat)* ;
pat: 'not'* (type id? | expr | ('<' | '>' | '<=' | '>=') unary | type? ('(' (subpat // ',')? ')')? '{' ((subpat // ',') ','?)? '}' id? | type? '(' (subpat // ',') ')' id? | '[' any* ']' | 'null') ;
subpat: ((id // '.') ':')? pattern ;
lambda: attr* ('async' | 'static')* (id | '(' (id // ',')? ')' | '(' params ')') '=>' (expr | block) | ('async' | 'static')* 'delegate' ('(' params? ')')? block ;
query: 'from' type? id 'in' expr any* ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '??' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '??=' ;
unary: pre* post ;
pre: '+' | '-' | '!' | '~' | '++' | '--' | '*' | '&' | '^' | 'await' | 'ref' | '(' type ')' ;
post: primary | post '.' id targs? | post '?' '.' id targs? | post '->' id | post '[' args ']' | post '?' '[' args ']' | post '(' args? ')' | post '++' | post '--' | post '!' ;
primary: id targs? | prim | id '::' id | NUM | STR | CHR | 'true' | 'false' | 'null' | 'this' | 'base' | '(' expr ')' | '(' (arg ',' (arg // ',')) ')' | new | ('typeof' | 'sizeof' | 'default' | 'checked' | 'unchecked') '(' (type | expr) ')' | 'default' | 'stackalloc' any | '[' ((vinit // ',') ','?)? ']' ;
new: 'new' (type)? '(' args? ')' objinit? | 'new' type objinit | 'new' btype '[' args ']' ('[' ','* ']')* arrinit? | 'new' '[' ','* ']' arrinit | 'new' objinit ;
objinit: '{' ((oinit // ',') ','?)? '}' ;
oinit: (id | '[' args ']') '=' (expr | objinit) | expr | arrinit ;
args: arg // ',' ;
arg: (id ':')? ('ref' | 'out' | 'in')? (expr | type id) ;
"""

RUST = """
crate: inner* item* ;
inner: '#' '!' '[' tt* ']' ;
attr: '#' '[' tt* ']' ;
tt: ANY | '$' | '@' | '~' | '(' tt* ')' | '[' tt* ']' | '{' tt* '}' ;
vis: 'pub' ('(' ('crate' | 'super' | 'self' | 'in' path) ')')? ;
item: attr* vis? kind | macitem ;
macitem: attr* path '!' ID? ('{' tt* '}' | '(' tt* ')' ';' | '[' tt* ']' ';') ;
kind: 'use' usetree ';' | 'extern' 'crate' (ID | 'self') ('as' ID)? ';' | 'mod' ID (';' | '{' inner* item* '}') | func | struct | enum | impl | trait | 'const' (ID | '_') ':' type ('=' expr)? ';' | 'static' 'mut'? ID ':' type ('=' expr)? ';' | 'type' ID gen? (':' bounds)? where? ('=' type)? where? ';' | 'unsafe'? 'extern' STR? '{' inner* item* '}' | 'union' ID gen? where? '{' fields? '}' ;
usetree: '::'? (useseg '::')* (useseg ('as' (ID | '_'))? | '*' | '{' ((usetree // ',') ','?)? '}') ;
useseg: ID | 'self' | 'super' | 'crate' ;
func: fq* 'fn' ID gen? '(' params? ')' ('->' type)? where? (block | ';') ;
fq: 'const' | 'async' | 'unsafe' | 'extern' STR? ;
params: (param // ',') ','? ;
param: attr* (self | pattern ':' type | type | '...') ;
self: ('&' LIFE?)? 'mut'? 'self' (':' type)? ;
gen: '<' ((gparam // ',') ','?)? '>' ;
gparam: attr* (LIFE (':' (LIFE // '+')?)? | ID (':' bounds?)? ('=' type)? | 'const' ID ':' type ('=' expr)?) ;
bounds: (bound // '+') '+'? ;
bound: LIFE | '?'? hrtb? path | '(' bound ')' | '~'? 'const' path ;
hrtb: 'for' gen ;
where: 'where' ((wpred // ',') ','?)? ;
wpred: hrtb? type ':' bounds? | LIFE ':' (LIFE // '+')? ;
struct: 'struct' ID gen? where? ('{' fields? '}' | ';') | 'struct' ID gen? '(' tfields? ')' where? ';' ;
fields: ((attr* vis? ID ':' type) // ',') ','? ;
tfields: ((attr* vis? type) // ',') ','? ;
enum: 'enum' ID gen? where? '{' ((variant // ',') ','?)? '}' ;
variant: attr* vis? ID ('{' fields? '}' | '(' tfields? ')')? ('=' expr)? ;
impl: 'unsafe'? 'impl' gen? 'const'? ('!'? type 'for')? type where? '{' inner* item* '}' ;
trait: 'unsafe'? 'auto'? 'trait' ID gen? (':' bounds?)? where? '{' inner* item* '}' ;
type: path | '&' LIFE? 'mut'? type | '&&' LIFE? 'mut'? type | '*' ('const' | 'mut') type | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' (type // ',') ','? ')' | '!' | '_' | ('dyn' | 'impl') bounds | hrtb? fq* 'fn' '(' ((fnp // ',') ','?)? ')' ('->' type)? | path '!' mac | hrtb path ;
fnp: attr* ((ID | '_') ':')? type | '...' ;
mac: '(' tt* ')' | '[' tt* ']' | '{' tt* '}' ;
path: '::'? (pseg // '::') | '<' type ('as' path)? '>' '::' (pseg // '::') ;
pseg: pid | pid targs | pid '::' targs | pid '(' ((type // ',') ','?)? ')' ('->' type)? ;
pid: ID | 'self' | 'Self' | 'super' | 'crate' ;
targs: '<' ((targ // ',') ','?)? '>' ;
targ: LIFE | type | NUM | STR | '-' NUM | 'true' | 'false' | block | ID '=' type | ID targs? ':' bounds ;
pattern: '|'? (pat // '|') ;
pat: '_' | '..' | 'ref'? 'mut'? ID ('@' pat)? | lit | lit? range lit? | ('&' | '&&') 'mut'? pat | '(' ((pattern // ',') ','?)? ')' | '[' ((pattern // ',') ','?)? ']' | epath | epath range (lit | epath) | epath '(' ((pattern // ',') ','?)? ')' | epath '{' ((fpat // ',') ','?)? '}' | path '!' mac | 'box' pat ;
fpat: attr* ((ID | NUM) ':' pattern | 'ref'? 'mut'? ID | '..') ;
range: '..' | '..=' | '...' ;
lit: NUM | '-' NUM | STR | CHR | 'true' | 'false' ;
block: '{' inner* stmt* expr? '}' ;
stmt: ';' | attr* 'let' pattern (':' type)? ('=' expr ('else' block)?)? ';' | item | attr* expr ';' | attr* blockexpr ;
blockexpr: (LIFE ':')? (block | 'loop' block | 'while' expr block | 'for' pattern 'in' expr block) | 'unsafe' block | 'async' 'move'? block | 'const' block | if | 'match' expr '{' inner* arms? '}' | path '!' '{' tt* '}' ;
if: 'if' expr block ('else' (if | block))? ;
arms: arm+ lastarm? | lastarm ;
arm: attr* pattern ('if' expr)? '=>' (expr ',' | blockexpr ','?) ;
lastarm: attr* pattern ('if' expr)? '=>' expr ;
expr: unary (op unary)* | unary (op unary)* range | range | range unary (op unary)* | unary (op unary)* range unary (op unary)* | 'let' pattern '=' expr ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '&&' 'let' pattern '=' ;
unary: pre* post | pre* post 'as' type | unary 'as' type | closure | 'return' expr? | 'break' LIFE? expr? | 'continue' LIFE? | 'yield' expr? ;
closure: 'static'? 'async'? 'move'? ('||' | '|' ((cparam // ',') ','?)? '|') (expr | '->' type block) ;
cparam: pat (':' type)? ;
pre: '-' | '!' | '*' | '&' | '&&' | '&' 'mut' | '&&' 'mut' | '&' 'raw' ('const' | 'mut') ;
post: prim | post '.' ID | post '.' ID '::' targs | post '.' NUM | post '.' 'await' | post '[' expr ']' | post '(' args? ')' | post '?' ;
epath: '::'? (eseg // '::') | '<' type ('as' path)? '>' '::' (eseg // '::') ;
eseg: pid | targs ;
prim: epath | NUM | STR | CHR | 'true' | 'false' | '(' ')' | '(' (expr // ',') ','? ')' | '[' ((expr // ',') ','?)? ']' | '[' expr ';' expr ']' | path '!' mac | epath '{' ((fexpr // ',') ','?)? ('..' expr)? '}' | epath '{' (fexpr // ',') ',' '..' expr '}' | blockexpr ;
fexpr: attr* ((ID | NUM) ':' expr | ID | '..') ;
args: ((attr* expr) // ',') ','? ;
"""

# JavaScript; what TypeScript adds is in the upper-case places
ECMA = """
program: stmt* ;
id: ID | 'of' | 'get' | 'set' | 'async' | 'from' | 'as' | 'static' | 'let' | 'await' | 'yield' | 'type' | 'target' | 'meta' | 'constructor' IDS ;
key: id | kw ;
kw: 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'switch' | 'case' | 'default' | 'var' | 'const' | 'function' | 'class' | 'new' | 'delete' | 'typeof' | 'instanceof' | 'in' | 'void' | 'throw' | 'try' | 'catch' | 'finally' | 'import' | 'export' | 'extends' | 'super' | 'this' | 'null' | 'true' | 'false' | 'with' | 'debugger' | 'enum' ;
stmt: block | ';' | exprs ';' | ('var' | 'let' | 'const') decls ';' | func | class | 'if' '(' exprs ')' stmt | 'if' '(' exprs ')' stmt 'else' stmt | 'while' '(' exprs ')' stmt | 'do' stmt 'while' '(' exprs ')' ';'? | for | 'return' exprs? ';' | 'break' id? ';' | 'continue' id? ';' | 'throw' exprs ';' | id ':' stmt | try | 'switch' '(' exprs ')' '{' (('case' exprs | 'default') ':' stmt*)* '}' | 'debugger' ';' | import | export | 'with' '(' exprs ')' stmt STMTS ;
block: '{' stmt* '}' ;
decls: decl // ',' ;
decl: bind ('=' assign)? ;
bind: (id | object | array) ANN ;
for: 'for' 'await'? '(' (('var' | 'let' | 'const') decls | exprs)? ';' exprs? ';' exprs? ')' stmt | 'for' 'await'? '(' ('var' | 'let' | 'const')? (bind | assign) ('of' | 'in') exprs ')' stmt ;
try: 'try' block ('catch' ('(' bind ')')? block)? ('finally' block)? ;
func: 'async'? 'function' '*'? id GEN params RET FBODY ;
params: '(' ((param // ',') ','?)? ')' ;
param: '...'? bindp ('=' assign)? ;
bindp: DECO (id | object | array) OPT ANN ;
class: DECO CMOD 'class' id? GEN ('extends' (post TARGS))? IMPL '{' member* '}' ;
member: ';' | DECO MMOD* ('async' | 'get' | 'set' | 'static' | '*')* mkey OPT GEN params RET FBODY | DECO MMOD* 'static'? mkey OPT ANN ('=' assign)? ';' | 'static' block MEMBERS ;
mkey: key | STR | NUM | '[' assign ']' | PRIVATE ;
import: 'import' STR with? ';' | 'import' TYPE (id | names | '*' 'as' id | id ',' names | id ',' '*' 'as' id) 'from' STR with? ';' ;
with: 'with' object ;
names: '{' ((name // ',') ','?)? '}' ;
name: TYPE (key | STR) ('as' (key | STR))? ;
export: 'export' ('default' (assign ';' | func | class DEXP) | ('var' | 'let' | 'const') decls ';' | func | class | TYPE names ('from' STR with?)? ';' | TYPE '*' ('as' (key | STR))? 'from' STR with? ';' EXPORTS) ;
exprs: assign // ',' ;
assign: cond | arrow | 'yield' '*'? assign | 'yield' | '...' assign ;
cond: item (op item)* | item (op item)* '?' assign ':' assign | item (op item)* aop assign ;
aop: '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' | '>' '>' '>=' | '**=' | '&&=' | '||=' | '??=' ;
arrow: 'async'? (id | GEN params RET) '=>' (assign | block) ;
item: pre* post CASTS ;
op: '+' | '-' | '*' | '/' | '%' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '===' | '!==' | '&&' | '||' | '&' | '|' | '^' | '<<' | '>' '>' | '>' '>' '>' | '**' | '??' | 'in' | 'instanceof' ;
pre: '+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await' PRE ;
post: prim | post '.' key | post '.' PRIVATE | post '?.' key | post '?.' '[' exprs ']' | post '?.' args | post '[' exprs ']' | post TARGS args | post STR | post '++' | post '--' | 'import' args | 'import' '.' id POST ;
prim: id | NUM | STR | REGEX | JSX | 'this' | 'super' | 'null' | 'true' | 'false' | '(' exprs ')' | object | array | func_expr | class | 'new' post_new | 'new' '.' 'target' | PRIVATE ;
func_expr: 'async'? 'function' '*'? id? GEN params RET block ;
post_new: prim_new TARGS args? ;
prim_new: prim | prim_new '.' key | prim_new '[' exprs ']' ;
args: '(' ((arg // ',') ','?)? ')' ;
arg: assign ;
array: '[' ','* (((assign) // (','+)) ','*)? ']' ;
object: '{' ((prop // ',') ','?)? '}' ;
prop: mkey ':' assign ANNP | id ('=' assign)? | '...' assign | ('async' | 'get' | 'set' | '*')* mkey GEN params RET block ;
"""


def ecma(typescript: bool) -> str:
    gone = {"IDS": "", "STMTS": "", "ANNP": "", "ANN": "", "GEN": "", "RET": "", "FBODY": "block", "OPT": "", "CMOD": "", "TARGS": "", "IMPL": "", "MMOD*": "", "MEMBERS": "", "TYPE": "", "DEXP": "", "EXPORTS": "", "CASTS": "", "PRE": "", "POST": "", "DECO": ""}
    more = {
        "IDS": "| 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'readonly' | 'private' | 'public' | 'protected' | 'override' | 'is' | 'keyof' | 'infer' | 'asserts' | 'satisfies' | 'unique' | 'implements' | 'global' | 'require'",
        "STMTS": "| tsdecl | 'declare' (tsdecl | func | class | ('var' | 'let' | 'const') decls ';') | 'import' id '=' assign ';' | 'export' '=' assign ';' | 'export' 'as' 'namespace' id ';'",
        "ANNP": "", "ANN": "('!'? ':' type)?", "GEN": "gen?", "RET": "(':' rtype)?", "FBODY": "(block | ';')", "OPT": "('?' | '!')?", "CMOD": "'abstract'?", "TARGS": "targs?", "IMPL": "('implements' (type // ','))?",
        "MMOD*": "('public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor')*", "MEMBERS": "| 'static'? 'readonly'? index sep?", "TYPE": "'type'?", "DEXP": "| tsdecl",
        "EXPORTS": "| tsdecl | 'declare' (tsdecl | func | class | ('var' | 'let' | 'const') decls ';') | 'import' id '=' assign ';'", "CASTS": "(('as' | 'satisfies') (type | 'const'))*", "PRE": "| '<' (type | 'const') '>'", "POST": "| post '!'", "DECO": "('@' post)*",
    }
    text = ECMA
    values = more if typescript else gone
    for k in sorted(values, key=len, reverse=True):
        if k == "DECO" and not typescript:
            continue
        text = text.replace(f" {k} ", f" {values[k]} ").replace(f" {k} ", f" {values[k]} ") if k != "MMOD*" else text.replace("MMOD*", values[k])
        text = text.replace(f"({k} ", f"({values[k]} ").replace(f" {k})", f" {values[k]})").replace(f": {k} ", f": {values[k]} ")
    if not typescript:
        return text.replace("DECO", "('@' post)*")
    # parameters of constructors carry modifiers
    text = text.replace("bindp: ", "bindp: ('public' | 'private' | 'protected' | 'readonly' | 'override')* ").replace("params: '('", "params: '(' ('this' ':' type ','?)?")
    return text + TS_TYPES


TS_TYPES = """
tsdecl: 'interface' id gen? ('extends' (type // ','))? objtype | 'type' id gen? '=' type ';' | 'const'? 'enum' id '{' ((emember // ',') ','?)? '}' | ('namespace' | 'module') (id // '.' | STR) block | 'global' block | 'module' STR ';' ;
emember: mkey ('=' assign)? ;
gen: '<' (gparam // ',') ','? '>' ;
gparam: ('const' | 'in' | 'out')? id ('extends' type)? ('=' type)? ;
targs: '<' (type // ',') '>' ;
rtype: type | 'asserts'? (id | 'this') 'is' type | 'asserts' (id | 'this') ;
type: utype | utype 'extends' utype '?' type ':' type | functype ;
functype: 'abstract'? 'new'? gen? params '=>' rtype ;
utype: ('|' | '&')? (ptype // ('|' | '&')) ;
ptype: ('keyof' | 'unique' | 'readonly' | 'infer')* stype | 'infer' id 'extends' stype ;
stype: tname targs? | 'void' | 'null' | 'this' | 'true' | 'false' | NUM | '-' NUM | STR | '(' type ')' | objtype | '[' ((telem // ',') ','?)? ']' | 'typeof' tname targs? | stype '[' type? ']' | 'import' '(' STR ')' ('.' tname)? targs? | 'typeof' 'import' '(' STR ')' ;
telem: '...'? type | '...'? id '?'? ':' type | type '?' ;
tname: id | tname '.' key ;
objtype: '{' ((tmember sep)* tmember)? sep? '}' ;
sep: ';' | ',' ;
tmember: ('readonly' | 'get' | 'set' | '-' | '+')* mkey '?'? (':' type)? | ('get' | 'set')? mkey '?'? gen? params (':' rtype)? | 'new'? gen? params (':' rtype)? | ('-' | '+')? 'readonly'? index ;
index: '[' id ':' type ']' ':' type | '[' id 'in' type ('as' type)? ']' ('-' | '+')? '?'? (':' type)? ;
"""

PYTHON = """
file: line* ;
line: NEWLINE | simple (';' simple)* ';'? NEWLINE | compound ;
suite: simple (';' simple)* ';'? NEWLINE | NEWLINE INDENT line+ DEDENT ;
simple: exprs | exprs (asg (exprs | yield))+ | exprs ':' expr ('=' (exprs | yield))? | yield | 'pass' | 'break' | 'continue' | 'return' exprs? | 'raise' (expr ('from' expr)?)? | 'global' ids | 'nonlocal' ids | 'del' exprs | 'assert' expr (',' expr)? | 'import' (dotas // ',') | 'from' ('.' | '...')* dotted? 'import' fromlist | 'type' ID tps? '=' expr ;
ids: ID // ',' ;
id: ID | 'match' | 'case' | 'type' | '_' ;
dotted: id // '.' ;
dotas: dotted ('as' id)? ;
fromlist: '*' | names | '(' names ','? ')' ;
names: nameas // ',' ;
nameas: id ('as' id)? ;
asg: '=' | '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
yield: 'yield' exprs? | 'yield' 'from' expr ;
compound: 'if' named ':' suite ('elif' named ':' suite)* else? | 'while' named ':' suite else? | 'async'? 'for' exprs 'in' exprs ':' suite else? | 'try' ':' suite (except+ else? final? | final) | 'async'? 'with' withs ':' suite | decorator* 'async'? 'def' id tps? '(' params? ')' ('->' exprs)? ':' suite | decorator* 'class' id tps? ('(' args? ')')? ':' suite | 'match' exprs ':' NEWLINE INDENT case+ DEDENT ;
case: 'case' patterns ('if' named)? ':' suite ;
patterns: (pat // ',') ','? ;
pat: '*'? expr ('as' id)? ;
else: 'else' ':' suite ;
final: 'finally' ':' suite ;
except: 'except' (expr ('as' id)?)? ':' suite | 'except' '*' expr ('as' id)? ':' suite ;
withs: (withitem // ',') | '(' (withitem // ',') ','? ')' ;
withitem: expr ('as' expr)? ;
decorator: '@' named NEWLINE ;
tps: '[' (tp // ',') ','? ']' ;
tp: ('*' | '**')? ID (':' expr)? ('=' expr)? ;
params: (param // ',') ','? ;
param: id (':' star)? ('=' expr)? | '*' | '/' | '*' id (':' star)? | '**' id (':' expr)? ;
exprs: (star // ',') ','? ;
star: '*' expr | named ;
named: expr | id ':=' expr ;
expr: bool | bool 'if' bool 'else' expr | lambda ;
lambda: 'lambda' lparams? ':' expr ;
lparams: (lparam // ',') ','? ;
lparam: id ('=' expr)? | '*' id? | '**' id | '/' ;
bool: not (('and' | 'or') not)* ;
not: 'not'* cmp ;
cmp: sum (cop sum)* | 'await' sum ;
cop: '<' | '>' | '==' | '>=' | '<=' | '!=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
sum: unary (op unary)* ;
op: '+' | '-' | '*' | '/' | '//' | '%' | '@' | '&' | '|' | '^' | '<<' | '>>' | '**' ;
unary: ('+' | '-' | '~' | 'await')* post ;
post: atom | post '.' id | post '(' args? ')' | post '[' subs ']' ;
subs: (sub // ',') ','? ;
sub: star | expr? ':' expr? | expr? ':' expr? ':' expr? ;
args: (arg // ',') ','? ;
arg: named | named compfor | id '=' expr | '*' expr | '**' expr ;
compfor: comp+ ;
comp: 'async'? 'for' exprs 'in' bool ('if' cond)* | 'async'? 'for' exprs 'in' lambda ;
cond: named ;
atom: id | NUM | strs | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' exprs ')' | '(' named compfor ')' | '(' yield ')' | '[' exprs? ']' | '[' named compfor ']' | '{' '}' | '{' exprs '}' | '{' named compfor '}' | '{' dicts '}' | '{' expr ':' expr compfor '}' ;
strs: STR+ ;
dicts: (ditem // ',') ','? ;
ditem: expr ':' expr | '**' expr ;
"""
