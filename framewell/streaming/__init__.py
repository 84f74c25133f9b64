"""framewell.streaming"""
