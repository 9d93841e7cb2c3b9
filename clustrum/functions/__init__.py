"""Column functions and the small numeric helpers behind them."""
