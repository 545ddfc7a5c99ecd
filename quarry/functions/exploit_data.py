"""Who is hit by a type of vulnerability and how, and hints for checking whether it can be used."""

from __future__ import annotations

#: Affected parties and greatest loss by type; other types take DEFAULT_IMPACT.
IMPACTS = {
    "access_control": ("所有用户, 协议资金", "协议全部 TVL"),
    "capability_leak": ("所有用户, 协议资金", "协议全部 TVL"),
    "oracle_manipulation": ("流动性提供者, 协议用户", "池子余额"),
    "overflow": ("流动性提供者, 协议用户", "池子余额"),
    "slippage": ("单次交易用户", "交易金额的滑点损失"),
    "precision_loss": ("后续存款用户", "后续存款的全部金额"),
}
DEFAULT_IMPACT = ("待确定", "待评估")
#: What an attacker gains, by type.
GAINS = {
    "overflow": "攻击者可以通过溢出计算获得超额代币或份额",
    "access_control": "攻击者可以执行本应受限的管理员操作",
    "capability_leak": "任何人都可以获取管理员权限",
    "oracle_manipulation": "攻击者可以操纵价格进行套利",
    "precision_loss": "攻击者可以窃取其他用户的存款",
    "slippage": "攻击者可以通过三明治攻击获利",
    "flash_loan_non_repayment": "攻击者可以借款不还",
    "resource_leak": "用户资产可能被永久锁定",
}
DEFAULT_GAIN = "攻击者可以利用此漏洞获利或破坏协议"
#: Usual entry functions, attack, precondition and impact by type; other types take DEFAULT_HINT.
HINTS = {
    "overflow": ("deposit, mint, swap, calculate, add_liquidity", "构造接近 u64::MAX 的输入值使乘法溢出", "函数接受外部数值输入，无溢出检查", "获得超额代币或份额"),
    "access_control": ("withdraw_all, set_fee, pause, mint, burn", "直接调用缺少权限检查的敏感函数", "函数是 public 且无 Capability 参数", "执行管理员操作，提取资金"),
    "oracle_manipulation": ("swap, borrow, liquidate, get_price", "通过闪电贷大额交易操纵 DEX 价格", "协议使用可操纵的价格源", "套利或恶意清算"),
    "precision_loss": ("deposit, redeem, calculate_shares", "首存者攻击：小额存入 + 大额捐赠", "池子为空或低余额状态", "窃取后续存款"),
    "slippage": ("swap, remove_liquidity", "三明治攻击：抢跑 + 尾随", "能监控并抢先执行交易", "提取交易滑点利润"),
    "flash_loan": ("borrow, flash_loan, flashloan", "1) Receipt 有 drop 能力可直接丢弃; 2) repay 函数未验证还款类型可用便宜币还贵币; 3) 存在其他函数可销毁 Receipt", "检查: Receipt 的 abilities、repay 是否校验还款币种与借款币种一致、是否有其他消费 Receipt 的路径", "借款不还或用低价值代币偿还高价值借款"),
    "type_confusion": ("repay, redeem, withdraw, swap", "泛型函数未验证类型参数与预期一致，可传入不同类型绕过检查", "函数使用泛型 <T> 但未校验 T 与存储的类型匹配", "用低价值资产换取高价值资产"),
    "capability_leak": ("init 函数或任何 Capability 创建点", "利用被 share_object 的 Capability", "Capability 被错误共享而非转移", "任何人获得管理员权限"),
    "resource_leak": ("process, handle, execute", "触发不处理资源的代码路径", "存在不处理 Coin/Balance 的分支", "资产永久丢失"),
}
DEFAULT_HINT = ("unknown", "需要分析具体代码", "需要分析具体条件", "需要评估具体影响")
#: Names of functions by which a type of vulnerability is usually entered, in order.
TYPICAL_ENTRIES = {
    "overflow": ["deposit", "mint", "swap", "add_liquidity", "calculate"],
    "precision_loss": ["deposit", "redeem", "withdraw", "calculate_shares"],
    "access_control": ["withdraw_all", "set_fee", "pause", "mint", "burn", "upgrade"],
    "capability_leak": ["init", "create", "transfer"],
    "oracle_manipulation": ["swap", "borrow", "liquidate", "get_price"],
    "flash_loan_non_repayment": ["borrow", "flash_loan"],
    "slippage": ["swap", "remove_liquidity"],
    "resource_leak": ["process", "handle", "execute"],
    "type_confusion": ["generic functions", "create<T>", "process<T>"],
}
#: Modules of the standard library.
LIBRARY_MODULES = [
    "event", "transfer", "object", "tx_context", "clock", "coin", "balance", "type_name", "linked_table", "table", "bag", "vec_map", "vec_set",
    "dynamic_field", "dynamic_object_field", "bcs", "hash", "ecdsa_k1", "vector", "option", "string", "ascii", "debug", "unit_test", "test_scenario", "test_utils",
]
