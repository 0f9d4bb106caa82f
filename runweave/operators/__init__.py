"""runweave.operators"""
