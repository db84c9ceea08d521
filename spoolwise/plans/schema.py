"""The edit plan as a Spark type."""

SEGMENT = "struct<start:double,end:double>"
CARD = "struct<title:string,lines:array<string>,seconds:double,image:string,qr:string>"
OVERLAY = "struct<start:double,end:double,text:string,position:string>"
LAYOUT = "struct<kind:string,screen:array<int>,speaker:array<int>,corner:string>"
CLIP = (
    f"struct<id:string,takeaway:string,segments:array<{SEGMENT}>,hook_offset_seconds:double,trim_silence:boolean,"
    f"crop_focus:string,card:{CARD},cards:array<{CARD}>,layout:{LAYOUT},overlays:array<{OVERLAY}>>"
)
MUSIC = "struct<path:string,under:string,gain_db:double,duck_db:double,fade_seconds:double,loop:boolean>"
TRANSITION = "struct<kind:string,seconds:double,module:string>"
REEL = (
    f"struct<filename:string,intro:{CARD},outro:{CARD},chapter_cards:string,opening:array<{CARD}>,closing:array<{CARD}>,"
    f"music:{MUSIC},transition:{TRANSITION},audio_fade_seconds:double>"
)
PLAN = (
    "struct<version:string,source:struct<path:string,duration_seconds:double,captions:struct<kind:string,path:string>>,"
    f"output:struct<dir:string,preset:string,aspect:string,captions:string,container:string,max_height:int,reel:{REEL}>,"
    f"clips:array<{CLIP}>,summary:struct<path:string>>"
)
PRESET_ASPECT = {"internal": "16:9", "linkedin": "16:9", "shorts": "9:16", "email": "16:9"}
PRESET_BOUNDS = {"internal": (15, 120), "linkedin": (15, 90), "shorts": (15, 60), "email": (15, 60)}
