"""runweave.functions"""
