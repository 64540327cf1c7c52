"""An agent simulation of wallets that pay each other, and its results as DataFrames."""
