"""runweave.sources"""
