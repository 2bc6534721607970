"""Declarations and scopes of Solidity sources."""

import pytest

from tarnbeck.operators import text as X
from tarnbeck.operators.scopes import code_line_counts, declarations, open_comments, tokens

SOURCE = """pragma solidity 0.8.20;
contract A {
    modifier onlyOwner() {
        require(msg.sender == owner);
        _;
    }
    address public owner;
    function set(uint256 v) public onlyOwner {
        value = v;
    }
    uint256 public value;
}
"""


def of(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return sorted(declarations(df, "i", "t").collect(), key=lambda r: (r.i, r.line, r.name))


def test_contract_function_and_modifier_lines(spark):
    rows = {(r.kind, r.name): r for r in of(spark, SOURCE)}
    assert {k: (r.line, r.line_end, r.holder) for k, r in rows.items()} == {
        ("pragma", "solidity 0.8.20"): (1, 1, None), ("contract", "A"): (2, 12, None), ("modifier", "onlyOwner"): (3, 6, "A"), ("variable", "owner"): (7, 7, "A"), ("function", "set"): (8, 10, "A"), ("variable", "value"): (11, 11, "A"),
    }
    f = rows["function", "set"]
    assert (f.visibility, f.mutability, f.modifiers, f.signature, f.truncated) == ("public", "nonpayable", ["onlyOwner"], "(uint256)", False)
    assert (rows["variable", "owner"].type, rows["variable", "value"].type) == ("address", "uint256")


@pytest.mark.parametrize(
    ("declared", "name", "kind", "marks"),
    [
        ("uint256 x;", "x", "uint256", []), ("address payable private y;", "y", "address payable", ["private"]), ("mapping(address => uint256) public balances;", "balances", "mapping(address=>uint256)", ["public"]),
        ("mapping ( address=>mapping(uint8 => bool[]) )\n   internal\n deep;", "deep", "mapping(address=>mapping(uint8=>bool[]))", ["internal"]), ("uint256[] public items;", "items", "uint256[]", ["public"]),
        ("bytes32[4][] grid;", "grid", "bytes32[4][]", []), ("bytes32 internal constant SLOT = keccak256('a;{b');", "SLOT", "bytes32", ["internal", "constant"]), ("uint8 immutable public n = 3 * (2 + 1);", "n", "uint8", ["immutable", "public"]),
        ("IERC20 token;", "token", "IERC20", []), ("Lib.Data private data;", "data", "Lib.Data", ["private"]), ("uint public override(A, B) total = f({a: 1, b: 2});", "total", "uint", ["public", "override"]),
        ("/* a */ bool // ; {\n  open = true;", "open", "bool", []), ("string s = \"uint z; }\";", "s", "string", []), ("uint[] xs = [1, 2];", "xs", "uint[]", []), ("uint256 private publicSale;", "publicSale", "uint256", ["private"]),
    ],
)
def test_state_variables(spark, declared, name, kind, marks):
    rows = [r for r in of(spark, f"contract A {{\n{declared}\n}}") if r.kind == "variable"]
    assert [(r.name, r.type, r.marks, r.holder) for r in rows] == [(name, kind, marks, "A")]


def test_members_are_told_from_locals_and_fields(spark):
    text = """// contract Not { uint no; }
import "./Token.sol";
import {X as Y} from '@pkg/access/Ownable.sol';
struct Top { uint a; }
uint constant FREE = 1;
function free(uint a) pure returns (uint) { uint z = a; return z; }
abstract contract A is B, C(1) {
    using Lib for uint;
    enum E { One, Two }
    struct S { uint field; mapping(uint => bool) inner; }
    event Done(address indexed who, uint[] values);
    error Bad(uint code);
    uint a;
    constructor(address o, uint256[] memory xs) B(o) payable { uint local = 1; { uint deeper; } }
    receive() external payable {}
    function g(function(uint) external f, bytes calldata d) external view virtual override(B, C) only(1, x) Lib.guard returns (uint r, bool) {
        uint b = 2;
        (bool ok, ) = d.call{value: 1}("");
        for (uint i = 0; i < 3; i++) { uint c; }
        unchecked { uint e; }
        assembly { let q := 1 }
    }
    function h() external;
    uint z;
}
interface I { function k() external returns (uint); }
library L { uint constant M = 2; }
"""
    rows = of(spark, text)
    assert [(r.kind, r.name, r.holder) for r in rows if r.kind in ("variable", "struct", "enum", "event", "error")] == [
        ("struct", "Top", None), ("enum", "E", "A"), ("struct", "S", "A"), ("event", "Done", "A"), ("error", "Bad", "A"), ("variable", "a", "A"), ("variable", "z", "A"), ("variable", "M", "L")]
    by = {r.name: r for r in rows}
    assert (by["./Token.sol"].kind, by["@pkg/access/Ownable.sol"].kind, by["free"].holder, by["k"].holder) == ("import", "import", None, "I")
    g = by["g"]
    assert (g.visibility, g.mutability, g.marks, g.modifiers) == ("external", "view", ["external", "virtual", "override"], ["only", "Lib.guard"])
    assert (by["constructor"].mutability, by["constructor"].modifiers, by["constructor"].signature, by["constructor"].line) == ("payable", ["B"], "(address,uint256[])", 14)
    assert (by["receive"].mutability, by["Done"].signature, by["h"].line_end - by["h"].line) == ("payable", "(address,uint[])", 0)
    assert {r.name for r in rows if r.kind in ("contract", "interface", "library")} == {"A", "I", "L"}


def test_pragmas(spark):
    rows = of(spark, "pragma solidity ^0.8.20;", "pragma solidity >=0.7.0 <0.9.0;", "pragma experimental ABIEncoderV2;")
    assert [r.name for r in rows] == ["solidity ^0.8.20", "solidity >=0.7.0<0.9.0", "experimental ABIEncoderV2"]


def test_a_body_without_its_end(spark):
    rows = of(spark, "pragma solidity 0.8.20;\ncontract A {\n    function f() external {\n        uint x = 1;\n")
    assert [(r.kind, r.truncated, r.line_end) for r in rows] == [("pragma", False, 1), ("contract", True, 4), ("function", True, 4)]


def test_awkward_texts(spark):
    rows = of(spark, None, "", "}}} contract", "contract A {} } contract B { uint x; }", "just some prose; nothing (more", "/* contract A { uint x; }", "x" * 50_000, '"' + "a" * 60_000)
    assert {r.i for r in rows} <= {3} and [r.name for r in rows][:1] == ["A"]


def test_unterminated_comments_and_strings(spark):
    df = spark.createDataFrame([(1, 'string s = "open;\nuint x;'), (2, "a /* b"), (3, '"a" \'b\' /* c */ // d'), (4, '"a\\"')], "i int, t string")
    assert sorted((r.i, r.line, r.issue) for r in open_comments(df, "i", "t").collect()) == [(1, 1, "unterminated string"), (2, 1, "unterminated comment"), (4, 1, "unterminated string")]


def test_code_lines_equal_masked_lines(spark):
    texts = [SOURCE, "a // b\n\n/* c\n d */ e\n'x // y'\n", "", "//\n/**/\n", "/*", 'x = "a /* b";\n*/', "\n\n  \t\n;"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    assert {r.i: r.n for r in code_line_counts(df, "i", "t").collect()} == {k: X.code_lines(x) for k, x in enumerate(texts)}
    assert tokens(df.limit(0), "i", "t").count() == 0 and declarations(df.limit(0), "i", "t").count() == 0
