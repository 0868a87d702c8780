"""Contract sources written for this engine, repositories that follow them for each supplier, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VAULT = """pragma solidity ^0.8.20;
import "./IERC20.sol";

contract Treasury is Ownable, Pausable {
    IERC20 public asset;
    address public keeper;
    uint256 public totalDebt;
    mapping(address => uint256) public shares;

    modifier onlyKeeper() {
        require(msg.sender == keeper, "keeper");
        _;
    }

    function initialize(address _asset, address _keeper) external {
        asset = IERC20(_asset);
        keeper = _keeper;
    }

    function deposit(uint256 amount) external {
        // pull the funds first
        asset.transferFrom(msg.sender, address(this), amount);
        shares[msg.sender] += amount;
    }

    function withdraw(uint256 amount) external {
        payable(msg.sender).call{value: amount}("");
        shares[msg.sender] -= amount;
        totalSupply -= amount;
    }

    function grantAllowance(address spender) external onlyOwner {
        asset.approve(spender, 100);
    }

    function sweep(address target, bytes calldata data) external {
        target.delegatecall(data);
    }

    function isKeeper() public view returns (bool) {
        require(tx.origin == keeper || msg.sender == owner, "role");
        return true;
    }
}
"""

ORACLE = """pragma solidity ^0.8.19;

interface IFeed {
    function latestRoundData() external view returns (uint80, int256, uint256, uint256, uint80);
}

contract PushOracle {
    IFeed public feed;
    uint256 public cachedPrice;
    uint256 public cachedTimestamp;
    uint256 constant STALE_AFTER = 3600;

    function updatePrice() external {
        (, int256 answer,,,) = feed.latestRoundData();
        cachedPrice = uint256(answer);
        cachedTimestamp = block.timestamp;
    }

    function price() external view returns (uint256) {
        require(cachedTimestamp > block.timestamp - STALE_AFTER, "stale");
        return cachedPrice;
    }

    function checked(uint256 updatedAt) external view returns (bool) {
        require(cachedPrice > 0 || updatedAt > 0, "oracle");
        return true;
    }
}
"""

GAME = """pragma solidity ^0.8.0;

contract HatchGame {
    mapping(uint256 => address) public depositors;
    uint256[] public players;

    function hatch(uint256 seed) external returns (uint256 egg) {
        uint256 random = uint256(keccak256(abi.encodePacked(block.timestamp, msg.sender, seed)));
        egg = random % 100;
        if (egg < 5) {
            mintReward(msg.sender);
        }
    }

    function depositEgg(uint256 id, address depositor) public {
        require(egg.ownerOf(id) == address(this), "custody");
        depositors[id] = depositor;
    }

    function payAll() external {
        for (uint256 i = 0; i < players.length; i++) {
            strategy.withdraw(players[i]);
        }
    }

    function convertToShares(uint256 assets) external view returns (uint256) {
        uint256 feeShares = _accrueFee(assets);
        return assets - feeShares;
    }

    function mintReward(address to) internal {
        balance += 1;
    }
}
"""

SAFE = """pragma solidity ^0.8.20;

/// A vault that guards what it does.
contract SafeBox is Ownable {
    uint256 private stored;

    constructor() {
        stored = 0;
    }

    /// Only the owner may store.
    function store(uint256 value) external onlyOwner {
        stored = value;
    }

    function read() external view returns (uint256) { return stored; }

    receive() external payable {}
}
"""

MARKET = """pragma solidity ^0.8.20;

interface IPriceFeed {
    function getPrice(address asset) external view returns (uint256);
}

contract MarketNFT is ERC721 {
    address public minter;

    function mint(address to, uint256 id) external {
        require(msg.sender == minter, "minter");
        ledger.mint(to, id);
    }
}

contract Market is Ownable {
    IERC20 public token;
    MarketNFT public badge;
    IPriceFeed public oracle;
    mapping(uint256 => Pool) public pools;
    uint256 public totalDebt;
    uint256[] public queue;
    bool private paused;

    modifier whenOpen() {
        require(!paused, "closed");
        _;
    }

    function borrow(uint256 id, uint256 amount) external whenOpen {
        Pool storage pool = pools[id];
        require(oracle.getPrice(address(token)) > 0, "price");
        pool.debt += amount;
        totalDebt += amount;
        queue.push(id);
        sendOut(msg.sender, amount);
    }

    function sendOut(address to, uint256 amount) internal {
        token.transfer(to, amount);
        logged(amount);
    }

    function logged(uint256 amount) private {
        emit Sent(amount);
    }

    function claim(uint256 id) external {
        badge.transferFrom(address(this), msg.sender, id);
        sendOut(msg.sender, id);
    }

    function setPaused(bool value) external onlyOwner {
        paused = value;
    }

    function closePool(uint256 id) public {
        /* closes for good */
        Pool storage pool = pools[id];
        pool.active = false;
        target.delegatecall(abi.encode(id));
    }

    function quote(uint256 id) public view returns (uint256) {
        return pools[id].debt * 2;
    }
}
"""

ORDERS = """pragma solidity ^0.8.20;

contract OrderBook {
    mapping(uint256 => Order) public orders;
    uint256 public orderFee;
    uint256 public orderPrecision;
    uint256 public nextOrder;
    IERC20 public payToken;

    function createOrder(uint256 price, uint256 amount) external returns (uint256 id) {
        Order storage order = orders[nextOrder];
        order.price = price;
        order.seller = msg.sender;
        nextOrder += 1;
    }

    function amendOrder(uint256 id, uint256 price) external {
        Order storage order = orders[id];
        require(order.seller == msg.sender, "seller");
        order.price = price;
    }

    function cancelOrder(uint256 id) external {
        Order storage order = orders[id];
        require(order.seller == msg.sender, "seller");
        require(block.timestamp < order.deadline, "late");
        order.isActive = false;
    }

    function buyOrder(uint256 id) external {
        Order storage order = orders[id];
        require(order.isActive && block.timestamp < order.deadline, "closed");
        uint256 fee = (order.price * orderFee) / orderPrecision;
        order.isActive = false;
        payToken.safeTransferFrom(msg.sender, order.seller, order.amount - fee);
    }

    function fillOrder(uint256 id, uint256 maxPrice, uint256 minReceive) external {
        Order storage order = orders[id];
        require(order.price <= maxPrice, "price");
        order.amount -= minReceive;
    }

    function feeOf(uint256 id) internal view returns (uint256) {
        return orders[id].price * orderFee;
    }
}
"""

#: repo, file_path, text.
SOURCES = (
    ("treasury", "src/Treasury.sol", VAULT),
    ("treasury", "src/PushOracle.sol", ORACLE),
    ("game", "contracts/HatchGame.sol", GAME),
    ("game", "test/HatchGame.t.sol", GAME.replace("HatchGame", "HatchGameTest")),
    ("safe", "src/SafeBox.sol", SAFE),
    ("safe", "lib/SafeBox.sol", SAFE.replace("SafeBox", "LibBox")),
)


#: The sources above, a market with calls between contracts, and an order book.
LINKED_SOURCES = (*SOURCES, ("market", "contracts/Market.sol", MARKET), ("book", "src/OrderBook.sol", ORDERS))


def sources(spark: SparkSession, rows=SOURCES) -> DataFrame:
    """repo, file_path, text."""
    return spark.createDataFrame(rows, "repo string, file_path string, text string")


#: Suppliers a task makes repositories of.
SUPPLIERS = 1000


def spread(rows: DataFrame, each: int, *keys: str) -> DataFrame:
    """``rows`` dealt over the cores, by ``keys`` if any, and over more tasks once a task would have more than ``each``: a small table is one file, and one task."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // each)), *keys)


def repositories(spark: SparkSession, sf_dir: str, rows=SOURCES) -> DataFrame:
    """repo, file_path, text: a repository for each supplier, after one of those in ``rows``.

    The supplier's key picks the repository it follows and names it; its balance, if negative, drops the owners' guards; its
    nation sets the delay and, if even, renames the keeper. So code and facts differ from repository to repository and
    grow with the table. A supplier becomes kilobytes of code, so suppliers are dealt over tasks before.
    """
    kinds = list(dict.fromkeys(r[0] for r in rows))
    patterns = spark.range(1).select(F.inline(F.array(*(F.struct(F.lit(kinds.index(repo)).alias("kind"), F.lit(repo).alias("name"), F.lit(path).alias("file_path"), F.lit(text).alias("given")) for repo, path, text in rows))))
    suppliers = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal").withColumn("kind", F.pmod("s_suppkey", F.lit(len(kinds))).cast("int"))
    guarded = F.when(F.col("s_acctbal") < 0, F.replace("given", F.lit(" onlyOwner"), F.lit(""))).otherwise(F.col("given"))
    delayed = F.replace(guarded, F.lit("3600"), (600 * (F.col("s_nationkey") + 1)).cast("int").cast("string"))
    renamed = F.when(F.col("s_nationkey") % 2 == 0, F.replace(delayed, F.lit("keeper"), F.concat(F.lit("keeper"), F.col("s_nationkey").cast("string")))).otherwise(delayed)
    return spread(suppliers, SUPPLIERS).join(F.broadcast(patterns), "kind").select(F.concat("name", F.lit("-"), F.col("s_suppkey").cast("string")).alias("repo"), "file_path", renamed.alias("text"))


def src_sql(rows=SOURCES) -> str:
    """The CTE src: ``repositories`` in SQL."""
    kinds = list(dict.fromkeys(r[0] for r in rows))
    values = values_sql([(kinds.index(repo), repo, path, text) for repo, path, text in rows], "kind, name, file_path, given")
    return f"""src AS (SELECT name || '-' || s_suppkey AS repo, file_path, CASE WHEN s_nationkey % 2 = 0 THEN replace(delayed, 'keeper', 'keeper' || s_nationkey) ELSE delayed END AS text
  FROM (SELECT *, replace(CASE WHEN s_acctbal < 0 THEN replace(given, ' onlyOwner', '') ELSE given END, '3600', CAST(600 * (s_nationkey + 1) AS VARCHAR)) AS delayed
        FROM supplier JOIN {values} ON kind = s_suppkey % {len(kinds)}))"""


def quoted(value) -> str:
    """A SQL literal."""
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def values_sql(rows, columns: str) -> str:
    """(VALUES ...) AS t(columns) of Python rows."""
    return "(VALUES " + ", ".join("(" + ", ".join(quoted(v) for v in row) + ")" for row in rows) + f") AS t({columns})"


def doubles(sql: str, *columns: str) -> str:
    """A query whose columns, decimal by their literals, are doubles of six places."""
    return f"SELECT * REPLACE ({', '.join(f'round(CAST({c} AS DOUBLE), 6) AS {c}' for c in columns)}) FROM ({sql})"


def lines_sql(rows=SOURCES) -> str:
    """CTEs src, lines, code, depths, contracts and ranges over sources."""
    return f"""{src_sql(rows)},
lines AS (
  SELECT repo, file_path, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line_no, unnest(string_split(text, chr(10))) AS raw FROM src),
code AS (SELECT *, split_part(raw, '//', 1) AS code FROM lines),
depths AS (
  SELECT *, sum(len(replace(code, '}}', '')) - len(replace(code, '{{', ''))) OVER (PARTITION BY repo, file_path ORDER BY line_no) AS depth_after,
         len(replace(code, '}}', '')) - len(replace(code, '{{', '')) AS delta FROM code),
decls AS (
  SELECT *, CASE WHEN regexp_extract(code, '\\bfunction\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) <> '' THEN regexp_extract(code, '\\bfunction\\s+([A-Za-z_][A-Za-z0-9_]*)', 1)
              ELSE regexp_extract(code, '\\b(constructor|receive|fallback)\\s*\\(', 1) END AS fn,
         (SELECT 1) AS one
  FROM depths
  WHERE regexp_matches(code, '\\bfunction\\s+[A-Za-z_]|\\bconstructor\\s*\\(|\\breceive\\s*\\(|\\bfallback\\s*\\(') AND contains(code, '{{')),
contracts AS (
  SELECT repo, file_path, line_no AS c_line, regexp_extract(code, '\\b(?:contract|interface|library)\\s+([A-Za-z_][A-Za-z0-9_]*)', 1) AS contract FROM depths
  WHERE regexp_matches(code, '\\b(contract|interface|library)\\s+[A-Za-z_]')),
ranges AS (
  SELECT d.repo, d.file_path, d.fn AS function_name, d.line_no AS start_line, d.raw AS decl, min(e.line_no) AS end_line,
         (SELECT arg_max(c.contract, c.c_line) FROM contracts c WHERE c.repo = d.repo AND c.file_path = d.file_path AND c.c_line <= d.line_no) AS contract_name
  FROM decls d JOIN depths e ON e.repo = d.repo AND e.file_path = d.file_path AND e.line_no >= d.line_no AND e.depth_after <= d.depth_after - d.delta
  GROUP BY ALL)"""


LINES_SQL = lines_sql()
SOURCES_SQL = src_sql()
