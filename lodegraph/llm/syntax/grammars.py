"""Bundled grammars, in the notation of glr.py. What they leave to later phases of a
compiler (names, types, targets of assignments, places of break and return) is accepted.
Precedence of operators makes no difference to what is valid, so operators are flat."""

from __future__ import annotations

PYTHON = r"""
file = (NEWLINE | statement)* ;
statement = simple | compound ;
simple = small %% ';' NEWLINE ;
small = assignment | stars | 'pass' | 'break' | 'continue' | 'return' stars? | 'raise' (expr ('from' expr)?)? | 'global' name % ',' | 'nonlocal' name % ','
  | 'del' stars | 'assert' expr (',' expr)? | 'import' dotted_as % ',' | 'from' source 'import' imported | 'type' name typeparams? '=' expr ;
assignment = stars ('=' value)+ | stars ':' expr ('=' value)? | stars augmented value ;
value = stars | yield ;
augmented = '+=' | '-=' | '*=' | '/=' | '//=' | '%=' | '@=' | '&=' | '|=' | '^=' | '>>=' | '<<=' | '**=' ;
dotted_as = name % '.' ('as' name)? ;
source = ('.' | '...')+ | ('.' | '...')* name % '.' ;
imported = '*' | (name ('as' name)?) % ',' | '(' (name ('as' name)?) %% ',' ')' ;
block = simple | NEWLINE INDENT statement+ DEDENT ;
compound = 'if' named ':' block ('elif' named ':' block)* ('else' ':' block)? | 'while' named ':' block ('else' ':' block)? | for | 'async' for | try | with | 'async' with
  | ('@' named NEWLINE)* (function | 'async' function | class) | match ;
for = 'for' stars 'in' stars ':' block ('else' ':' block)? ;
try = 'try' ':' block (except+ ('else' ':' block)? ('finally' ':' block)? | 'finally' ':' block) ;
except = 'except' '*'? (exprs ('as' name)?)? ':' block ;
exprs = expr % ',' ;
with = 'with' item % ',' ':' block | 'with' '(' item %% ',' ')' ':' block ;
item = expr ('as' star)? ;
function = 'def' name typeparams? '(' parameters? ')' ('->' expr)? ':' block ;
typeparams = '[' (('*' | '**')? name (':' expr)? ('=' star)?) %% ',' ']' ;
parameters = parameter %% ',' ;
parameter = name (':' star)? ('=' expr)? | '*' (name (':' star)?)? | '**' name (':' expr)? | '/' ;
class = 'class' name typeparams? ('(' arguments? ')')? ':' block ;
match = 'match' subject ':' NEWLINE INDENT case+ DEDENT ;
subject = starnamed %% ',' ;
case = 'case' patterns ('if' named)? ':' block ;
patterns = pattern_item %% ',' ;
pattern_item = '*' name | pattern ;
pattern = or_pattern ('as' name)? ;
or_pattern = closed % '|' ;
closed = name % '.' | 'None' | 'True' | 'False' | STR+ | signed (('+' | '-') NUM)? | '(' patterns? ')' | '[' patterns? ']' | '{' (mapped %% ',')? '}' | name % '.' '(' (pattern_arg %% ',')? ')' ;
signed = '-'? NUM ;
mapped = (name % '.' | 'None' | 'True' | 'False' | STR+ | signed (('+' | '-') NUM)?) ':' pattern | '**' name ;
pattern_arg = pattern | name '=' pattern ;
stars = star %% ',' | yield ;
star = '*' bitor | named ;
starnamed = '*' bitor | named ;
yield = 'yield' stars? | 'yield' 'from' expr ;
named = name ':=' expr | expr ;
expr = disjunction | disjunction 'if' disjunction 'else' expr | 'lambda' lambda_parameters? ':' expr ;
lambda_parameters = (name ('=' expr)? | '*' name? | '**' name | '/') %% ',' ;
disjunction = inversion | disjunction ('and' | 'or') inversion ;
inversion = 'not' inversion | comparison ;
comparison = bitor | comparison compare bitor ;
compare = '==' | '!=' | '<' | '>' | '<=' | '>=' | 'in' | 'not' 'in' | 'is' | 'is' 'not' ;
bitor = factor | bitor binary factor ;
binary = '|' | '^' | '&' | '<<' | '>>' | '+' | '-' | '*' | '/' | '//' | '%' | '@' ;
factor = ('+' | '-' | '~') factor | power ;
power = awaited | awaited '**' factor ;
awaited = 'await' primary | primary ;
primary = atom | primary '.' name | primary '(' arguments? ')' | primary '[' slices ']' ;
slices = slice %% ',' ;
slice = starnamed | expr? ':' expr? (':' expr?)? ;
arguments = argument %% ',' ;
argument = named comprehension? | '*' expr | '**' expr | name '=' expr ;
comprehension = clause+ ;
clause = 'async'? 'for' targets 'in' disjunction_if ('if' condition)* ;
targets = ('*'? bitor) %% ',' ;
disjunction_if = disjunction | 'lambda' lambda_parameters? ':' expr ;
condition = disjunction | name ':=' disjunction ;
atom = name | NUM | STR+ | 'None' | 'True' | 'False' | '...' | '(' ')' | '(' stars ')' | '(' named comprehension ')' | '[' ']' | '[' starnamed %% ',' ']' | '[' named comprehension ']'
  | '{' '}' | '{' starnamed %% ',' '}' | '{' named comprehension '}' | '{' pair %% ',' '}' | '{' expr ':' expr comprehension '}' ;
pair = expr ':' expr | '**' bitor ;
name = NAME | 'match' | 'case' | 'type' ;
"""

_SCRIPT = r"""
program = item* ;
item = statement | declaration | import | export ;
statements = (statement | declaration)* ;
block = '{' statements '}' ;
statement = block | ';' | expr ';' | 'if' '(' expr ')' body ('else' body)? | 'for' '(' for_head ')' body | 'for' 'await' '(' for_head ')' body | 'while' '(' expr ')' body
  | 'do' body 'while' '(' expr ')' ';' | 'do' body 'while' '(' expr ')' | 'return' expr? ';' | 'break' ident? ';' | 'continue' ident? ';' | 'throw' expr ';'
  | 'try' block ('catch' ('(' binding type_note ')')? block)? ('finally' block)? | 'switch' '(' expr ')' '{' ('case' expr ':' statements | 'default' ':' statements)* '}'
  | ident ':' statement | 'var' declarator % ',' ';' | 'debugger' ';' | 'with' '(' expr ')' body ;
body = statement | function ;
for_head = (('var' | 'let') declarator % ',' | 'const' initialized % ',')? ';' expr? ';' expr? | expr ';' expr? ';' expr? | ('var' | 'let' | 'const') binding ('of' | 'in') expr | postfix ('of' | 'in') expr ;
declaration = 'let' declarator % ',' ';' | 'const' initialized % ',' ';' | function | class_declaration ;
declarator = binding note ('=' assign)? ;
binding = ident | '{' (bound %% ',')? '}' | '[' elision (binding_item elision)* ']' ;
elision = ','* ;
binding_item = binding ('=' assign)? | '...' binding ;
bound = ident ('=' assign)? | property_key ':' binding ('=' assign)? | '...' binding ;
function = 'async'? 'function' '*'? ident signature function_end ;
class_declaration = decorators 'class' ident class_tail ;
class_tail = type_parameters ('extends' heritage)? implements '{' member* '}' ;
decorators = ('@' decorator)* ;
decorator = ident | decorator '.' ident | decorator '(' (argument %% ',')? ')' | '(' expr ')' ;
member = ';' | decorators modifiers method | decorators modifiers key optional note ('=' assign)? ';' | 'static' block ;
method = 'async'? '*'? key optional signature function_end | ('get' | 'set') key signature function_end ;
key = property_key | PRIVATE ;
property_key = anyname | STR | NUM | '[' assign ']' ;
parameters = parameter %% ',' ;
anyname = ident | reserved ;
reserved = 'if' | 'else' | 'for' | 'while' | 'do' | 'return' | 'break' | 'continue' | 'throw' | 'try' | 'catch' | 'finally' | 'switch' | 'case' | 'default' | 'var' | 'let' | 'const' | 'function' | 'class'
  | 'extends' | 'new' | 'delete' | 'typeof' | 'void' | 'in' | 'instanceof' | 'this' | 'super' | 'null' | 'true' | 'false' | 'import' | 'export' | 'await' | 'yield' | 'debugger' | 'with' ;
import = 'import' STR attributes ';' | 'import' clause 'from' STR attributes ';' ;
clause = ident | ident ',' names | names ;
names = '*' 'as' ident | '{' (name_pair %% ',')? '}' ;
name_pair = ident | (anyname | STR) 'as' (anyname | STR) ;
attributes = (('with' | NAME) '{' ((anyname | STR) ':' STR) %% ',' '}')? ;
export = 'export' declaration | 'export' 'var' declarator % ',' ';' | 'export' 'default' (function | class_declaration | 'async'? 'function' '*'? signature block | 'class' class_tail | assign ';')
  | 'export' '{' (exported %% ',')? '}' ('from' STR attributes)? ';' | 'export' '*' ('as' (anyname | STR))? 'from' STR attributes ';' ;
exported = (anyname | STR) ('as' (anyname | STR))? ;
expr = assign % ',' ;
assign = conditional | postfix assigning assign | arrow | 'yield' '*'? assign | 'yield' ;
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '**=' | '<<=' | '>>=' | '>>>=' | '&=' | '|=' | '^=' | '&&=' | '||=' | '??=' ;
conditional = binary | binary '?' assign ':' assign ;
binary = unary | binary operator unary | PRIVATE 'in' unary ;
operator = '+' | '-' | '*' | '/' | '%' | '**' | '==' | '!=' | '===' | '!==' | '<' | '>' | '<=' | '>=' | '&&' | '||' | '??' | '&' | '|' | '^' | '<<' | 'in' | 'instanceof' | shift_right ;
unary = ('+' | '-' | '!' | '~' | '++' | '--' | 'typeof' | 'void' | 'delete' | 'await') unary | postfix | postfix ('++' | '--') ;
postfix = primary | postfix member_access | postfix call | postfix template | 'new' new_target call? | 'import' '(' (argument %% ',') ')' | 'import' '.' ident | 'super' call | 'super' member_access ;
member_access = '.' (ident | PRIVATE) | '?.' (ident | PRIVATE) | '[' expr ']' | '?.' '[' expr ']' | '?.' '(' (argument %% ',')? ')' ;
call = '(' (argument %% ',')? ')' ;
new_target = primary | new_target '.' (ident | PRIVATE) | new_target '[' expr ']' | new_target template | 'new' new_target call | '.' ident ;
argument = assign | '...' assign ;
primary = ident | NUM | STR | REGEX | template | 'this' | 'null' | 'true' | 'false' | '(' expr ')' | '[' elision (argument | argument ',' elision | argument ',' elision)? ']' | array | object
  | 'async'? 'function' '*'? ident? signature block | 'class' ident? class_tail | JSXSTART ('{' (expr | '...' assign)? '}')* JSXEND ;
array = '[' elision argument (','+ argument)* elision ']' ;
object = '{' (property %% ',')? '}' ;
property = property_key ':' assign | ident | ident '=' assign | '...' assign | 'async'? '*'? property_key signature block | ('get' | 'set') property_key signature block ;
template = TEMPLATE | HEAD expr (MIDDLE expr)* TAIL ;
"""

JAVASCRIPT = (
    _SCRIPT
    + r"""
note = ;
type_note = ;
optional = ;
type_parameters = ;
implements = ;
heritage = postfix ;
modifiers = 'static'? ;
initialized = binding '=' assign ;
signature = '(' parameters? ')' ;
function_end = block ;
parameter = binding ('=' assign)? | '...' binding ;
arrow = 'async'? (ident | '(' parameters? ')') '=>' (assign | block) ;
shift_right = '>>' | '>>>' ;
ident = NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'static' ;
"""
)

TYPESCRIPT = (
    _SCRIPT.replace(
        "declaration = ",
        "declaration = 'interface' ident type_parameters ('extends' type_name % ',')? object_type | 'type' ident type_parameters '=' type ';' | 'const'? 'enum' ident '{' (enum_item %% ',')? '}' | 'abstract' class_declaration | 'declare' declared"
        " | ('namespace' | 'module') (ident % '.' | STR) '{' item* '}' | 'global' '{' item* '}' | ",
    )
    .replace("import = ", "import = 'import' 'type' clause 'from' STR attributes ';' | 'import' ident '=' (NAME '(' STR ')' | ident % '.') ';' | ")
    .replace("export = ", "export = 'export' 'type' '{' (exported %% ',')? '}' ('from' STR attributes)? ';' | 'export' 'type' '*' ('as' ident)? 'from' STR ';' | 'export' '=' expr ';' | 'export' 'as' 'namespace' ident ';' | 'export' 'default' 'abstract' class_declaration | 'export' 'default' 'interface' ident type_parameters ('extends' type_name % ',')? object_type | ")
    .replace("name_pair = ", "name_pair = 'type' ident | 'type' anyname 'as' ident | ")
    .replace("exported = ", "exported = 'type' (anyname | STR) ('as' (anyname | STR))? | ")
    .replace("member = ", "member = modifiers index_signature ';' | ")
    .replace("binary = unary |", "binary = unary | binary ('as' | 'satisfies') type | binary 'as' 'const' |")
    .replace("postfix = primary |", "postfix = primary | postfix '!' | postfix type_arguments call | postfix '?.' type_arguments call |")
    .replace("'new' new_target call?", "'new' new_target call? | 'new' new_target type_arguments call")
    .replace("unary = (", "unary = '<' type '>' unary | (")
    .replace("'catch' ('(' binding type_note ')')?", "'catch' ('(' binding note ')')?")
    + r"""
note = (':' type)? | '!' ':' type ;
initialized = binding (':' type)? '=' assign | binding ':' type ;
optional = '?'? | '!' ;
declared = 'var' declarator % ',' ';' | declaration ;
enum_item = (ident | STR | '[' STR ']' | reserved) ('=' assign)? ;
type_parameters = ('<' ('const'? ('in' | 'out')? ident ('extends' type)? ('=' type)?) %% ',' '>')? ;
implements = ('implements' type_name % ',')? ;
heritage = postfix | postfix type_arguments ;
modifiers = ('public' | 'private' | 'protected' | 'static' | 'readonly' | 'abstract' | 'override' | 'declare' | 'accessor')* ;
signature = type_parameters '(' parameters? ')' (':' returned)? ;
returned = type | 'asserts'? (ident | 'this') 'is' type | 'asserts' (ident | 'this') ;
function_end = block | ';' ;
parameter = decorators modifiers binding '?'? note ('=' assign)? | '...' binding note | 'this' ':' type ;
arrow = 'async'? (ident | signature) '=>' (assign | block) ;
shift_right = '>' '>' | '>' '>' '>' ;
type_arguments = '<' type %% ',' '>' ;
type = union_type | union_type 'extends' union_type '?' type ':' type | type_parameters '(' parameters? ')' '=>' returned | 'abstract'? 'new' type_parameters '(' parameters? ')' '=>' type ;
union_type = ('|' | '&')? type_operator % ('|' | '&') ;
type_operator = ('keyof' | 'unique' | 'readonly') type_operator | 'infer' ident ('extends' type_operator)? | array_type ;
array_type = simple_type | array_type '[' ']' | array_type '[' type ']' ;
simple_type = type_name | 'this' | 'null' | 'true' | 'false' | 'void' | STR | '-'? NUM | template_type | '(' type ')' | '[' (tuple_item %% ',')? ']' | object_type | 'typeof' query | mapped_type
  | 'import' '(' STR ')' ('.' ident)* type_arguments? ;
query = ident type_arguments? | query '.' ident type_arguments? | 'import' '(' STR ')' ;
template_type = TEMPLATE | HEAD type (MIDDLE type)* TAIL ;
tuple_item = '...'? type | '...'? ident '?'? ':' type | type '?' ;
type_name = ident % '.' type_arguments? ;
object_type = '{' (type_member (';' | ','))* type_member? '}' ;
type_member = 'readonly'? property_key '?'? (':' type)? | property_key '?'? signature | ('get' | 'set') property_key signature | signature | 'new' signature | 'readonly'? index_signature ;
index_signature = '[' ident ':' type ']' (':' type)? ;
mapped_type = '{' (('+' | '-')? 'readonly')? '[' ident 'in' type ('as' type)? ']' (('+' | '-')? '?')? (':' type)? ';'? '}' ;
ident = NAME | 'async' | 'of' | 'get' | 'set' | 'from' | 'as' | 'static' | 'type' | 'interface' | 'namespace' | 'module' | 'declare' | 'abstract' | 'global' | 'enum' | 'satisfies' | 'public' | 'private' | 'protected'
  | 'readonly' | 'override' | 'accessor' | 'implements' | 'keyof' | 'unique' | 'infer' | 'is' | 'asserts' | 'out' ;
"""
)

GO = r"""
file = ('package' NAME ';' ('import' imports ';')* (declaration ';')*)? ;
imports = import | '(' (import ';')* import? ')' ;
import = (NAME | '.')? STR ;
declaration = 'const' group_const | 'var' group_var | 'type' group_type | 'func' NAME type_parameters? signature block? | 'func' parameters NAME signature block? ;
group_const = const | '(' (const ';')* const? ')' ;
const = NAME % ',' type? ('=' exprs)? ;
group_var = var | '(' (var ';')* var? ')' ;
var = NAME % ',' type ('=' exprs)? | NAME % ',' '=' exprs ;
group_type = type_spec | '(' (type_spec ';')* type_spec? ')' ;
type_spec = NAME '='? type | NAME type_parameters '='? type ;
type_parameters = '[' (NAME % ',' constraint) %% ',' ']' ;
constraint = ('~'? type) % '|' ;
signature = parameters result? ;
result = parameters | type ;
parameters = '(' (parameter %% ',')? ')' ;
parameter = type | NAME type | NAME? '...' type ;
type = type_name | '*' type | '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | 'chan' type | 'chan' '<-' type | '<-' 'chan' type | 'func' signature | struct | interface | '(' type ')' ;
type_name = NAME | NAME '.' NAME | type_name '[' type %% ',' ']' ;
struct = 'struct' '{' (field ';')* field? '}' ;
field = NAME % ',' type STR? | '*'? type_name STR? ;
interface = 'interface' '{' (element ';')* element? '}' ;
element = NAME signature | constraint ;
block = '{' statements '}' ;
statements = (statement? ';')* statement? ;
statement = simple | 'const' group_const | 'var' group_var | 'type' group_type | 'go' expr | 'defer' expr | 'return' exprs? | 'break' NAME? | 'continue' NAME? | 'goto' NAME | 'fallthrough' | block | if | for | switch | select | NAME ':' statement? ;
simple = expr | exprs assign exprs | exprs ':=' exprs | expr ('++' | '--') | expr '<-' expr ;
assign = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>>=' | '&^=' ;
if = 'if' (simple? ';')? expr block ('else' (if | block))? ;
for = 'for' block | 'for' expr block | 'for' simple? ';' expr? ';' simple? block | 'for' 'range' expr block | 'for' exprs ('=' | ':=') 'range' expr block ;
switch = 'switch' (simple? ';')? (expr | NAME ':=' expr)? '{' case* '}' ;
case = ('case' case_items | 'default') ':' statements ;
case_items = (expr | type) % ',' ;
select = 'select' '{' (('case' simple | 'default') ':' statements)* '}' ;
exprs = expr % ',' ;
expr = unary | expr binary unary ;
binary = '||' | '&&' | '==' | '!=' | '<' | '<=' | '>' | '>=' | '+' | '-' | '|' | '^' | '*' | '/' | '%' | '<<' | '>>' | '&' | '&^' ;
unary = ('+' | '-' | '!' | '^' | '*' | '&' | '<-') unary | primary ;
primary = operand | primary '.' NAME | primary '.' '(' (type | 'type') ')' | primary '[' index ']' | primary '(' arguments? ')' | literal ;
index = argument %% ',' | expr? ':' expr? | expr? ':' expr ':' expr ;
arguments = argument %% ',' | argument % ',' '...' ','? ;
argument = expr | composite_type | 'func' signature | '*' composite_type ;
operand = NUM | STR | NAME | '(' argument ')' | 'func' signature block | composite_type '(' argument ','? ')' ;
composite_type = '[' ']' type | '[' (expr | '...') ']' type | 'map' '[' type ']' type | struct | interface | 'chan' type | '<-' 'chan' type | 'chan' '<-' type ;
literal = (composite_type | type_name) body ;
body = '{' (keyed %% ',')? '}' ;
keyed = (value ':')? value ;
value = expr | body ;
"""

RUST = r"""
file = inner* item* ;
inner = '#' '!' '[' tree* ']' ;
outer = '#' '[' tree* ']' ;
tree = leaf | '(' tree* ')' | '[' tree* ']' | '{' tree* '}' ;
item = outer* visibility item_kind | outer* path '!' NAME? macro_end ;
macro_end = '{' tree* '}' | '(' tree* ')' ';' | '[' tree* ']' ';' ;
visibility = ('pub' ('(' ('crate' | 'super' | 'self' | 'in' path) ')')?)? ;
item_kind = 'use' use_tree ';' | 'mod' NAME ';' | 'mod' NAME '{' inner* item* '}' | function | struct | enum | 'union' NAME generics where '{' fields? '}' | trait | impl | 'type' NAME generics (':' bounds)? where ('=' type)? where ';'
  | ('const' | 'static' 'mut'?) (NAME | '_') ':' type ('=' expr)? ';' | 'extern' 'crate' NAME ('as' (NAME | '_'))? ';' | 'unsafe'? 'extern' STR? '{' inner* item* '}' ;
use_tree = use_path | use_path 'as' (NAME | '_') | (use_path? '::')? '*' | (use_path? '::')? '{' (use_tree %% ',')? '}' ;
use_path = '::'? segment_name % '::' ;
segment_name = NAME | 'crate' | 'self' | 'super' | 'union' | 'Self' ;
function = ('const' | 'async' | 'unsafe' | 'extern' STR?)* 'fn' NAME generics '(' (parameter %% ',')? ')' ('->' type)? where (block | ';') ;
parameter = outer* (self_parameter | pattern ':' type | '...') ;
self_parameter = ('&' LIFETIME?)? 'mut'? 'self' (':' type)? ;
generics = ('<' (generic %% ',')? '>')? ;
generic = outer* (LIFETIME (':' LIFETIME % '+')? | NAME (':' bounds?)? ('=' type)? | 'const' NAME ':' type ('=' (block | '-'? literal | NAME))?) ;
bounds = bound %% '+' ;
bound = LIFETIME | '?'? for_lifetimes path_type | '(' '?'? for_lifetimes path_type ')' | '~'? 'const' path_type ;
for_lifetimes = ('for' '<' (LIFETIME %% ',')? '>')? ;
where = ('where' (clause %% ',')?)? ;
clause = LIFETIME ':' bounds? | for_lifetimes type ':' bounds? ;
struct = 'struct' NAME generics where ('{' fields? '}' | ';') | 'struct' NAME generics '(' (tuple_field %% ',')? ')' where ';' ;
fields = (outer* visibility NAME ':' type ('=' expr)?) %% ',' ;
tuple_field = outer* visibility type ;
enum = 'enum' NAME generics where '{' (variant %% ',')? '}' ;
variant = outer* visibility NAME ('{' fields? '}' | '(' (tuple_field %% ',')? ')')? ('=' expr)? ;
trait = 'unsafe'? 'auto'? 'trait' NAME generics (':' bounds?)? where '{' inner* item* '}' ;
impl = 'unsafe'? 'impl' generics (('const'? '!'? type) 'for')? type where '{' inner* item* '}' ;
type = path_type | '&' LIFETIME? 'mut'? type_single | '&&' LIFETIME? 'mut'? type_single | '*' ('const' | 'mut') type_single | '[' type ']' | '[' type ';' expr ']' | '(' ')' | '(' type ')' | '(' type ',' (type %% ',')? ')' | '!' | '_'
  | 'impl' bounds | 'dyn' bounds | for_lifetimes ('unsafe' | 'extern' STR?)* 'fn' '(' (((NAME | '_') ':')? type) %% ',' ')' ('->' type_single)? | for_lifetimes ('unsafe' | 'extern' STR?)* 'fn' '(' ')' ('->' type_single)? | qualified | path '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') ;
type_single = type ;
path_type = '::'? type_segment % '::' ;
type_segment = segment_name generic_arguments? | segment_name '::' generic_arguments | segment_name '(' (type %% ',')? ')' ('->' type_single)? ;
generic_arguments = '<' (generic_argument %% ',')? '>' ;
generic_argument = LIFETIME | type | '-'? literal | block | NAME generic_arguments? '=' type | NAME generic_arguments? ':' bounds ;
qualified = '<' type ('as' path_type)? '>' '::' type_segment % '::' ;
path = '::'? path_segment % '::' ;
path_segment = segment_name | segment_name '::' generic_arguments ;
block = '{' inner* statement* expr? '}' ;
statement = ';' | item | outer* 'let' pattern_or (':' type)? ('=' expr ('else' block)?)? ';' | outer* expr ';' | outer* block_expr ;
block_expr = label? block | ('unsafe' | 'async' 'move'? | 'const' | 'try') block | label? 'loop' block | label? 'while' condition block | label? 'for' pattern_or 'in' expr block | if | match ;
label = LIFETIME ':' ;
condition = expr | conditions ;
conditions = (expr | let) % '&&' ;
let = 'let' pattern_or '=' range ;
if = 'if' condition block ('else' (block | if))? ;
match = 'match' expr '{' inner* arm* last_arm? '}' ;
arm = outer* pattern_or guard '=>' (expr ',' | block_expr ','?) ;
last_arm = outer* pattern_or guard '=>' expr ;
guard = ('if' condition)? ;
expr = range | unary_place assigning expr | 'return' expr? | 'break' LIFETIME? expr? | 'continue' LIFETIME? | closure ;
unary_place = range ;
closure = 'static'? 'async'? 'move'? ('||' | '|' (closure_parameter %% ',')? '|') (expr | '->' type block) ;
closure_parameter = outer* pattern (':' type)? ;
assigning = '=' | '+=' | '-=' | '*=' | '/=' | '%=' | '&=' | '|=' | '^=' | '<<=' | '>' '>=' ;
range = binary | binary ('..' | '..=') | binary ('..' | '..=') binary | '..' | ('..' | '..=') binary ;
binary = unary | binary operator unary | binary 'as' type | binary operator closure ;
operator = '+' | '-' | '*' | '/' | '%' | '&' | '|' | '^' | '<<' | '>' '>' | '==' | '!=' | '<' | '>' | '<=' | '>=' | '&&' | '||' ;
unary = ('-' | '*' | '!') unary | ('&' | '&&') ('mut' | 'raw' ('const' | 'mut'))? unary | postfix ;
postfix = primary | postfix '.' (NAME | NUM | 'await' | 'union') | postfix '.' NAME '::' generic_arguments '(' (expr %% ',')? ')' | postfix '(' (expr %% ',')? ')' | postfix '[' expr ']' | postfix '?' ;
primary = literal | path | qualified | path '{' (struct_field (',' struct_field)* (',' ('..' expr?)?)? | '..' expr?)? '}' | path '!' ('(' tree* ')' | '[' tree* ']' | '{' tree* '}') | '(' expr ')' | '(' ')' | '(' expr ',' (expr %% ',')? ')'
  | '[' (expr %% ',')? ']' | '[' expr ';' expr ']' | block_expr | '_' ;
struct_field = outer* (NAME | NUM) ':' expr | outer* NAME ;
literal = NUM | STR | 'true' | 'false' ;
pattern_or = '|'? pattern % '|' ;
pattern = 'ref'? 'mut'? NAME ('@' pattern)? | literal_pattern | literal_pattern ('..=' | '..' | '...') literal_pattern | literal_pattern '..' | '..=' literal_pattern | '..' | '_' | ('&' | '&&') 'mut'? pattern | '(' (pattern_or %% ',')? ')' | '[' (pattern_or %% ',')? ']'
  | pattern_path | pattern_path '(' (pattern_or %% ',')? ')' | pattern_path '{' (field_pattern %% ',')? '}' | path '!' '(' tree* ')' | 'box' pattern ;
pattern_path = path | qualified ;
field_pattern = outer* ((NAME | NUM) ':' pattern_or | 'ref'? 'mut'? NAME | '..') ;
literal_pattern = '-'? NUM | STR | 'true' | 'false' | path ;
leaf = NAME | NUM | STR | LIFETIME | LEAVES ;
"""

SOLIDITY = r"""
file = unit* ;
unit = 'pragma' ';' | import | contract | function | struct | enum | event | error | 'type' NAME 'is' type ';' | using | type attribute* NAME ('=' expr)? ';' ;
import = 'import' STR ('as' NAME)? ';' | 'import' '{' (NAME ('as' NAME)?) %% ',' '}' NAME STR ';' | 'import' '*' 'as' NAME NAME STR ';' ;
contract = ('abstract'? 'contract' | 'interface' | 'library') ident ('is' base % ',')? '{' part* '}' ;
base = dotted ('(' (expr % ',')? ')')? ;
dotted = ident % '.' ;
part = function | struct | enum | event | error | modifier | using | 'type' NAME 'is' type ';' | type attribute* ident ('=' expr)? ';'
  | 'constructor' parameters function_attribute* block | ('receive' | 'fallback') parameters function_attribute* ('returns' parameters)? (block | ';') ;
function = 'function' (ident | 'receive' | 'fallback') parameters function_attribute* ('returns' parameters)? (block | ';') ;
function_attribute = 'external' | 'public' | 'internal' | 'private' | 'pure' | 'view' | 'payable' | 'virtual' | 'constant' | 'override' ('(' dotted % ',' ')')? | base ;
attribute = 'public' | 'internal' | 'private' | 'constant' | 'immutable' | 'transient' | 'override' ('(' dotted % ',' ')')? ;
parameters = '(' (parameter % ',')? ')' ;
parameter = type location? ident? ;
location = 'memory' | 'storage' | 'calldata' ;
struct = 'struct' ident '{' (type ident ';')* '}' ;
enum = 'enum' ident '{' (ident % ',')? '}' ;
event = 'event' ident '(' ((type 'indexed'? ident?) % ',')? ')' 'anonymous'? ';' ;
error = 'error' ident parameters ';' ;
modifier = 'modifier' ident parameters? ('virtual' | 'override' ('(' dotted % ',' ')')?)* (block | ';') ;
using = 'using' (dotted | '{' (dotted ('as' operator)?) % ',' '}') 'for' ('*' | type) 'global'? ';' ;
type = elementary | dotted | 'mapping' '(' type ident? '=>' type ident? ')' | type '[' expr? ']' | 'function' parameters ('external' | 'internal' | 'public' | 'private' | 'pure' | 'view' | 'payable')* ('returns' parameters)? ;
elementary = 'address' 'payable'? | 'bool' | 'string' | 'bytes' | 'var' ;
block = '{' statement* '}' ;
statement = block | 'unchecked' block | simple ';' | 'if' '(' expr ')' statement ('else' statement)? | 'for' '(' (simple? ';') expr? ';' expr? ')' statement | 'while' '(' expr ')' statement | 'do' statement 'while' '(' expr ')' ';' | 'continue' ';' | 'break' ';'
  | 'return' expr? ';' | 'emit' expr ';' | 'revert' expr ';' | 'throw' ';' | 'try' expr ('returns' parameters)? block catch+ | 'assembly' STR? ('(' STR % ',' ')')? '{' tree* '}' ;
catch = 'catch' (ident? parameters)? block ;
simple = expr | type location? ident ('=' expr)? | '(' ','* (parameter ','*)+ ')' '=' expr ;
expr = conditional | conditional assigning expr ;
assigning = '=' | '|=' | '^=' | '&=' | '<<=' | '>>=' | '>>>=' | '+=' | '-=' | '*=' | '/=' | '%=' ;
conditional = binary | binary '?' expr ':' expr ;
binary = unary | binary operator unary ;
operator = '+' | '-' | '*' | '/' | '%' | '**' | '<<' | '>>' | '>>>' | '<' | '>' | '<=' | '>=' | '==' | '!=' | '&' | '|' | '^' | '&&' | '||' | '~' | '!' ;
unary = ('++' | '--' | '-' | '!' | '~' | 'delete' | '+') unary | postfix | postfix ('++' | '--') ;
postfix = primary | postfix '.' (ident | 'address') | postfix '[' expr? ']' | postfix '[' expr? ':' expr? ']' | postfix '(' arguments? ')' | postfix '{' (ident ':' expr) %% ',' '}' | 'new' type ;
arguments = expr % ',' | '{' ((ident ':' expr) %% ',')? '}' ;
primary = ident | NUM NAME? | STR+ | 'true' | 'false' | elementary | 'type' '(' type ')' | 'payable' | '(' ','* (expr ','*)* ')' | '[' expr % ',' ']' | 'mapping' ;
ident = NAME | 'error' | 'receive' | 'fallback' | 'global' | 'revert' | 'transient' ;
tree = leaf | '(' tree* ')' | '{' tree* '}' | '[' tree* ']' ;
leaf = NAME | NUM | STR | LEAVES ;
"""


def with_leaves(grammar: str) -> str:
    """The grammar with LEAVES spelled out: all its literals but brackets."""
    import re

    marks = sorted({m for m in re.findall(r"'((?:[^'\\]|\\.)+)'", grammar) if m not in ("(", ")", "[", "]", "{", "}")} | {"=>", "->", "$", ";", ",", "@", "~"})
    return grammar.replace("LEAVES", " | ".join(f"'{m}'" for m in marks))
