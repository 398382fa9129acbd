"""Column expressions and the small Python helpers behind them."""
