"""The built-in pattern catalogue: fixed values, stated plainly and in order."""

from quarry.operators.scan import Pattern

#: Fixed values. Regexes are applied ignoring case to the whole text.
BUILT_IN = [
    Pattern('BUILTIN-001', 'Potential Arithmetic Overflow', 'high', ('overflow', 'math_safety'), ('* ', 'amount *', 'value *', 'price *', 'fee *'), r'\b\w+\s*\*\s*\w+'),
    Pattern('BUILTIN-002', 'Missing Access Control Check', 'high', ('access_control', 'privilege'), ('admin', 'owner', 'cap'), r'public\s+fun\s+\w+.*(?:admin|set_|update_|remove_|add_)'),
    Pattern('BUILTIN-003', 'Unchecked Division (Potential Div-by-Zero)', 'medium', ('div_zero', 'math_safety'), ('/', 'div'), r'\b\w+\s*/\s*\w+'),
    Pattern('BUILTIN-004', 'Flash Loan Without Proper Repayment Check', 'high', ('flash_loan', 'defi'), ('flash', 'loan', 'borrow', 'repay', 'receipt'), r'(flash|loan|borrow).*receipt'),
    Pattern('BUILTIN-005', 'Oracle Price Manipulation Risk', 'high', ('oracle', 'price_manipulation'), ('oracle', 'price', 'pyth', 'get_price'), r'(get_price|oracle|price_feed)'),
    Pattern('BUILTIN-006', 'Linear Resource Not Properly Handled', 'medium', ('linear_resource', 'type_safety'), ('coin', 'balance', 'receipt'), r'(Coin<|Balance<|Receipt)'),
    Pattern('BUILTIN-007', 'Missing Input Validation', 'low', ('validation', 'input_check'), ('amount', 'value', 'rate', 'bps'), r'public\s+fun\s+\w+\s*\([^)]*(?:amount|value|rate)'),
    Pattern('BUILTIN-008', 'Liquidation Logic Risk', 'high', ('liquidation', 'defi', 'lending'), ('liquidat', 'collateral', 'health', 'ratio'), r'(liquidat|health_factor|collateral_ratio)'),
    Pattern('BUILTIN-009', 'Shared Object Without Access Control', 'high', ('access_control', 'shared_object', 'sui'), ('&mut ', 'public fun', 'entry fun'), r'public\s+(entry\s+)?fun\s+\w+[^{]*&mut\s+\w+'),
    Pattern('BUILTIN-010', 'Coin Type Confusion', 'high', ('type_safety', 'coin', 'sui'), ('Coin<T>', 'Balance<T>', '<T>'), r'fun\s+\w+<\s*T\s*>[^{]*(?:Coin|Balance)<\s*T\s*>'),
    Pattern('BUILTIN-011', 'Object Ownership Transfer Risk', 'high', ('ownership', 'transfer', 'sui'), ('transfer::', 'public_transfer', 'share_object'), r'(transfer::public_transfer|transfer::share_object)\s*\('),
    Pattern('BUILTIN-012', 'Capability Leak via Public Transfer', 'high', ('capability', 'access_control', 'sui'), ('Cap', 'Capability', 'public_transfer'), r'public_transfer\s*\([^)]*Cap'),
    Pattern('BUILTIN-013', 'Clock/Timestamp Manipulation Risk', 'medium', ('timestamp', 'clock', 'sui'), ('clock', 'timestamp', 'Clock', 'timestamp_ms'), r'clock::timestamp_ms|&Clock'),
    Pattern('BUILTIN-014', 'Flash Loan Callback Order', 'high', ('flash_loan', 'hot_potato', 'sui'), ('flash', 'borrow', 'repay', 'Receipt'), r'public\s+fun\s+(flash_|borrow)[^}]+Receipt'),
    Pattern('BUILTIN-015', 'BCS Deserialization Without Validation', 'medium', ('deserialization', 'external_data', 'sui'), ('bcs::', 'from_bytes', 'deserialize'), r'bcs::(from_bytes|to_bytes)|deserialize'),
    Pattern('BUILTIN-016', 'Reentrancy via Shared Object', 'high', ('reentrancy', 'shared_object', 'sui'), ('&mut ', 'external call', 'callback'), r'public\s+fun\s+\w+[^{]*&mut[^{]+\w+::\w+\s*\('),
    Pattern('BUILTIN-017', 'Flash Loan Repayment Type Confusion', 'critical', ('flash_loan', 'type_safety', 'defi', 'sui'), ('flashloan', 'flash_loan', 'repay', 'Receipt', 'type_name', 'Coin<'), r'(repay|flash).*<\s*\w+\s*>.*Coin<\s*\w+\s*>'),
    Pattern('BUILTIN-018', 'Hot Potato Receipt Without Type Verification', 'critical', ('flash_loan', 'hot_potato', 'type_safety', 'sui'), ('Receipt', 'FlashReceipt', 'repay', 'pool_id', 'amount'), r'struct\s+\w*Receipt\s*\{[^}]*pool_id[^}]*\}'),
]
