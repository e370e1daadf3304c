"""Schemas of the mail operators."""

ADDRESS = "addr_type string, display_name string, mailbox string, hostname string, address string, scheme string, port int, path string"
ADDRESS_LIST = f"parsed array<struct<{', '.join(f.replace(' ', ':', 1) for f in ADDRESS.split(', '))}>>, unparsed array<string>, error string"
HEADER = "name string, raw string, value string, params map<string,string>"
_HEADERS = "array<struct<name:string,raw:string,value:string,params:map<string,string>>>"
PART = (
    "part_id:int,parent_id:int,path:array<int>,depth:int,rel:string,start:int,end:int,body_start:int,main:string,sub:string,params:map<string,string>,"
    f"disposition:string,disposition_params:map<string,string>,encoding:string,headers:{_HEADERS}"
)
PARSED = f"parts array<struct<{PART}>>, error string, parser string"
